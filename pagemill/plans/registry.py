"""The queries of the library and their DuckDB counterparts, by name."""

from __future__ import annotations

from . import extra_queries, ledger_queries, reference_queries, rule_queries, shard_queries  # noqa: F401  they add their queries
from .page_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
