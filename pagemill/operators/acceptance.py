"""Sources whose content changed: their records go in all tables together, and only once the change is accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from .settle import settled


class SourceChanged(ValueError):
    """Sources changed and nobody accepted it; no table was changed."""


def decisions(recorded: DataFrame, seen: DataFrame, accepted: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, decision, changed``: same, new, gone, accepted or refused, and the identity's fields that differ (nulls are values).

    ``accepted`` holds the keys whose change is accepted.
    """
    old = recorded.select(key, *[F.col(f).alias(f"__old_{f}") for f in fields], F.lit(True).alias("__recorded"))
    new = seen.select(key, *[F.col(f).alias(f"__new_{f}") for f in fields], F.lit(True).alias("__seen"))
    yes = accepted.select(key).distinct().withColumn("__yes", F.lit(True))
    both = old.join(new, key, "full_outer").join(yes, key, "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"__old_{f}").eqNullSafe(F.col(f"__new_{f}")), F.lit(f)) for f in fields]))
    decision = (
        F.when(F.col("__recorded").isNull(), "new").when(F.col("__seen").isNull(), "gone").when(F.size(differ) == 0, "same")
        .when(F.col("__yes"), "accepted").otherwise("refused")
    )
    changed = F.when(F.col("__recorded") & F.col("__seen"), F.array_join(differ, ",")).otherwise("")
    return both.select(key, decision.alias("decision"), changed.alias("changed"))


def left_after(records: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Records but those of sources whose change is accepted. Without a source they stay."""
    return records.join(decided.where("decision = 'accepted'").select(key), key, "left_anti")


def accept_sources(log: CommitLog, seen: DataFrame, accepted: DataFrame, key: str, fields: list[str], tables: list[str], sources: str = "sources") -> int | None:
    """Bring the recorded identities up to what was ``seen``, and drop the records of changed sources from all ``tables``, in one commit.

    A change that isn't accepted stops it: nothing is written. Gives the new version, or nothing where all was the same.
    The identities of sources that weren't seen stay.
    """
    base = log.version()
    recorded = log.read(sources, base)
    decided = settled(decisions(recorded, seen, accepted, key, fields))
    refused = decided.where("decision = 'refused'").orderBy(key).limit(20).collect()
    if refused:
        raise SourceChanged("; ".join(f"{r[key]}: {r['changed']}" for r in refused))
    if decided.where("decision IN ('accepted', 'new')").isEmpty():
        return None
    unseen = recorded.join(seen.select(key), key, "left_anti")
    identities = seen.select(*[c for c in recorded.columns if c in seen.columns]).unionByName(unseen, allowMissingColumns=True).select(*recorded.columns)
    counts = {r["decision"]: r["count"] for r in decided.groupBy("decision").count().collect()}
    changes = {sources: identities} | {t: left_after(log.read(t, base), decided, key) for t in tables}
    return log.commit(changes, base, note={"sources": counts})


def rows_by_source(tables: dict[str, DataFrame], decided: DataFrame, key: str) -> DataFrame:
    """``key, table, before, after``: how many records a source has in each table, and how many stay."""
    parts = [df.groupBy(key).agg(F.count("*").alias("before")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.join(decided.select(key, "decision"), key, "left").select(key, "table", "before", F.when(F.col("decision") == "accepted", 0).otherwise(F.col("before")).cast("long").alias("after"))
