"""Reports on the usage that batches recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from .ledger import USAGE_FIELDS, violations


def usage_violations(batches: DataFrame) -> DataFrame:
    """Negative counts, and more cached input than input (a missing field counts as 0)."""
    rules = {f"negative-{f}": (F.col(f"usage.{f}") < 0, F.col(f"usage.{f}")) for f in USAGE_FIELDS}
    rules["cached-over-input"] = (F.coalesce("usage.cached_input_tokens", F.lit(0)) > F.coalesce("usage.input_tokens", F.lit(0)), F.col("usage.cached_input_tokens"))
    return violations(batches.where("usage is not null"), "usage", F.col("batch_id"), rules)


def usage_totals(batches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Batches, pages, totals of the six counters and the derived shares, for all rows or for each key."""
    sums = [F.coalesce(F.sum(F.coalesce(f"usage.{f}", F.lit(0))), F.lit(0)).cast("long").alias(f) for f in USAGE_FIELDS]
    heads = [F.count("*").alias("batch_count"), F.count("usage").alias("batches_with_usage"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("page_count")]
    out = batches.groupBy(*(keys or [])).agg(*heads, *sums)
    return out.withColumn("uncached_input_tokens", F.col("input_tokens") - F.col("cached_input_tokens")).withColumn("usage_coverage", ratio(F.col("batches_with_usage"), F.col("batch_count"))).withColumn("cache_hit_ratio", ratio(F.col("cached_input_tokens"), F.col("input_tokens")))


def batches_without_usage(batches: DataFrame) -> DataFrame:
    return batches.where("usage is null").select("batch_id").distinct()
