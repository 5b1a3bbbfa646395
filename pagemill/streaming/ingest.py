"""Streams of shards into a ledger, and rolling reports over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import ledger_additions, match_ledger, merge_violations

BATCHES = "batch_id string, shard_sha256 string, owned_pages array<int>"


class LedgerConflict(ValueError):
    """A shard contradicts the ledger; nothing of its micro-batch is added."""


def read_batches(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """The ledger as it is; an empty table before its first write."""
    try:
        return spark.read.schema(schema).parquet(ledger)
    except Exception as e:  # the folder comes with the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ingest(batch: DataFrame, ledger: str, violations: str | None = None, schema: str = BATCHES) -> int:
    """Append what is new of a micro-batch; content that is there is skipped, so a repeated batch changes nothing.

    Contradictions (another content, a page owned twice) stop it before any write, or go to the table ``violations``
    with nothing added.
    """
    spark = batch.sparkSession
    # copies of a shard within the micro-batch are one
    new = batch.dropDuplicates(["batch_id", "shard_sha256"]).persist()  # read by every test
    try:
        there = read_batches(spark, ledger, schema)
        # the ledger's pages only where the new batches' are, so a micro-batch's work doesn't grow with what the ledger holds but for its scan
        broken = merge_violations(new, there, touched=True)
        if not broken.isEmpty():
            if violations is None:
                raise LedgerConflict(", ".join(f"{r['rule_id']} {r['entity_key']}" for r in broken.limit(20).collect()))
            broken.write.mode("append").parquet(violations)
            return 0
        added = ledger_additions(new, there).persist()
        try:
            n = added.count()
            if n:
                added.write.mode("append").parquet(ledger)
            return n
        finally:
            added.unpersist()
    finally:
        new.unpersist()


def ingest_stream(stream: DataFrame, ledger: str, checkpoint: str, violations: str | None = None, schema: str = BATCHES, **trigger) -> StreamingQuery:
    """A query that ingests each micro-batch; the checkpoint resumes it, and a batch that is run again adds nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: ingest(df, ledger, violations, schema) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def classify_stream(stream: DataFrame, ledger: DataFrame) -> DataFrame:
    """New batches of a stream against a fixed ledger: add, skip or conflict."""
    return match_ledger(stream, ledger)


def usage_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window of event time; state of closed windows is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events without a gap between, with their number and times."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "events", "first_ts", "last_ts")
