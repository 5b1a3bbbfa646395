"""Queries on shards, ledgers, usage and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, usage
from ..sources import tables
from .page_queries import query

SHARDS_SQL = """(SELECT l_orderkey AS batch_id, l_linenumber AS page, CASE l_returnflag WHEN 'A' THEN 'rebuilt' WHEN 'N' THEN 'pending' ELSE 'blocked' END AS status, l_quantity::BIGINT AS block_count,
    l_partkey % 7 AS object_count, l_suppkey % 3 AS continuity_count, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS uncertainty_count, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


@query("shard_summary", f"""
    SELECT batch_id, count(*) AS owned_page_count, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in-progress') AS in_progress, count(*) FILTER (status = 'rebuilt') AS rebuilt,
           count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'omitted-with-reason') AS omitted_with_reason, sum(block_count)::BIGINT AS block_count, sum(object_count)::BIGINT AS object_count,
           sum(continuity_count)::BIGINT AS continuity_count, sum(uncertainty_count)::BIGINT AS uncertainty_count, count(*) FILTER (uncertainty_count > 0) AS uncertain_page_count,
           count(*) FILTER (status = 'blocked' OR uncertainty_count > 0) > 0 AS review_required
    FROM {SHARDS_SQL} GROUP BY batch_id
""")  # fmt: skip
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.shard_summary(tables.shard_pages(spark, d), ["batch_id"])


@query("ownership_conflicts", f"SELECT part AS page, count(DISTINCT batch_id) AS batches, min(batch_id) AS first_batch, max(batch_id) AS last_batch FROM {SHARDS_SQL} GROUP BY part HAVING count(DISTINCT batch_id) > 1")
def q_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ownership_conflicts(tables.shard_pages(spark, d).select("batch_id", F.col("part").alias("page")))


@query("duplicate_keys", f"SELECT batch_id, page, count(*) AS n FROM {SHARDS_SQL} GROUP BY ALL HAVING count(*) > 1")
def q_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ledger.duplicate_keys(tables.shard_pages(spark, d), ["batch_id", "page"])


NEW_SQL = "(SELECT o_orderkey AS batch_id, sha256(concat_ws('|', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 10 = 0 THEN 'changed' ELSE o_orderpriority END)) AS sha FROM orders)"
OLD_SQL = "(SELECT o_orderkey AS batch_id, sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderpriority)) AS sha FROM orders WHERE o_orderstatus = 'F')"


def _new(spark: SparkSession, d: str) -> DataFrame:
    """Shards of all orders; a tenth of them has another content than the ledger."""
    content = F.when(F.col("o_orderkey") % 10 == 0, "changed").otherwise(F.col("o_orderpriority"))
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), content), 256).alias("shard_sha256"))


@query("ledger_new_batches", f"SELECT n.batch_id, n.sha AS shard_sha256 FROM {NEW_SQL} n ANTI JOIN {OLD_SQL} o USING (batch_id)")
def q_new(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger_additions(_new(spark, d), tables.ledger_batches(spark, d))


@query("ledger_idempotent_skip", f"SELECT n.batch_id, CASE WHEN o.batch_id IS NULL THEN 'add' WHEN o.sha = n.sha THEN 'skip' ELSE 'conflict' END AS action FROM {NEW_SQL} n LEFT JOIN {OLD_SQL} o USING (batch_id)")
def q_skip(spark: SparkSession, d: str) -> DataFrame:
    return ledger.match_ledger(_new(spark, d), tables.ledger_batches(spark, d)).select("batch_id", "action")


def _owned(spark: SparkSession, d: str) -> DataFrame:
    """Every order owns pages 1 to 4."""
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"))


OWNED_SQL = "(SELECT o_orderkey AS batch_id, unnest([1, 2, 3, 4]) AS page FROM orders)"


@query("missing_page_records", f"SELECT batch_id, page FROM {OWNED_SQL} ANTI JOIN {SHARDS_SQL} s USING (batch_id, page)")
def q_missing(spark: SparkSession, d: str) -> DataFrame:
    return ledger.missing_records(_owned(spark, d), tables.shard_pages(spark, d), ["batch_id", "page"])


@query("unexpected_page_records", f"SELECT batch_id, page FROM {SHARDS_SQL} ANTI JOIN {OWNED_SQL} o USING (batch_id, page)")
def q_unexpected(spark: SparkSession, d: str) -> DataFrame:
    return ledger.unexpected_records(_owned(spark, d), tables.shard_pages(spark, d), ["batch_id", "page"])


@query("manifest_reconcile", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT doc_id + CASE WHEN doc_id % 3 = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A listing of all documents, a third of them under another number, against the labelled ones."""
    docs = tables.table(spark, d, "documents").select((F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1000000000).otherwise(0)).alias("doc_id"))
    return ledger.reconcile(docs, tables.table(spark, d, "labels"), ["doc_id"])


IDENTITY_SQL = "SELECT doc_id, concat_ws(',', CASE WHEN sha256(text) IS DISTINCT FROM sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) THEN 'sha256' END, CASE WHEN doc_id % 10 = 0 THEN 'size_bytes' END, CASE WHEN doc_id % 4 = 0 THEN 'page_count' END) AS fields FROM documents"


@query("identity_mismatch", f"SELECT * FROM ({IDENTITY_SQL}) WHERE fields <> ''")
def q_identity(spark: SparkSession, d: str) -> DataFrame:
    """Content keys (digest, size, pages) of documents against ones of which some were changed."""
    docs = tables.table(spark, d, "documents")
    seen = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("size_bytes"), F.lit(1).alias("page_count"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    expected = docs.select("doc_id", F.sha2(changed, 256).alias("sha256"), (F.length("text") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).cast("long").alias("size_bytes"), F.when(F.col("doc_id") % 4 != 0, F.lit(1)).alias("page_count"))
    return ledger.identity_mismatches(seen, expected, "doc_id", ["sha256", "size_bytes", "page_count"])


@query("snapshot_consistency", "SELECT source, count(DISTINCT CASE WHEN lang <> 'en' THEN sha256(lang) END) AS digests, arg_min(CASE WHEN lang <> 'en' THEN sha256(lang) END, doc_id) FILTER (lang <> 'en') AS adopted, count(DISTINCT CASE WHEN lang <> 'en' THEN sha256(lang) END) <= 1 AS consistent FROM documents GROUP BY source")
def q_snapshot(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents").select("source", "doc_id", F.when(F.col("lang") != "en", F.sha2("lang", 256)).alias("digest"))
    return ledger.snapshot_consistency(docs, ["source"], "digest", "doc_id")


@query("upsert_pages", """
    SELECT doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.size ELSE o.size END AS size, CASE WHEN n.doc_id IS NOT NULL THEN coalesce(n.pdf, o.pdf) ELSE o.pdf END AS pdf
    FROM (SELECT doc_id, n_chars AS size, source AS pdf FROM documents) o
    FULL JOIN (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 1000000 ELSE 0 END AS doc_id, quality::BIGINT AS size, CASE WHEN toxic = 1 THEN 'new' END AS pdf FROM labels) n USING (doc_id)
""")  # fmt: skip
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Labels replace documents' records; a source without a new value keeps the old one."""
    old = tables.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), F.col("source").alias("pdf"))
    new_id = F.col("doc_id") + F.when(F.col("doc_id") % 50 == 0, 1000000).otherwise(0)
    new = tables.table(spark, d, "labels").select(new_id.alias("doc_id"), F.col("quality").cast("long").alias("size"), F.when(F.col("toxic") == 1, "new").alias("pdf"))
    return ledger.upsert(old, new, ["doc_id"], inherit=["pdf"])


@query("last_write_wins", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_last(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_write(tables.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("uniform_or_mixed", "SELECT user_id, date_trunc('day', ts) AS day, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed' END AS event_type FROM events GROUP BY ALL")
def q_uniform(spark: SparkSession, d: str) -> DataFrame:
    """The kind of event that a user's day has, if it has one kind."""
    days = tables.table(spark, d, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), "event_type")
    return ledger.uniform_or(days, ["user_id", "day"], "event_type", F.lit("mixed"))


USAGE_SQL = """(SELECT user_id AS batch_id, 1 + event_id % 3 AS page_count, event_type <> 'view' AS used, CASE WHEN event_type <> 'view' THEN (props->>'k')::BIGINT END AS k,
    CASE WHEN event_type <> 'view' THEN floor(abs(value) * 100)::BIGINT END AS ms, event_type FROM events)"""
TOTALS_SQL = """count(*) AS batch_count, count(*) FILTER (used) AS batches_with_usage, sum(page_count)::BIGINT AS page_count, coalesce(sum(k * 10), 0)::BIGINT AS input_tokens, coalesce(sum(k), 0)::BIGINT AS output_tokens,
    coalesce(sum(k) FILTER (event_type = 'click'), 0)::BIGINT AS cached_input_tokens, 0::BIGINT AS reasoning_tokens, coalesce(sum(ms), 0)::BIGINT AS duration_ms, count(*) FILTER (event_type = 'error') AS retry_count"""
DERIVED_SQL = "*, input_tokens - cached_input_tokens AS uncached_input_tokens, round(batches_with_usage / batch_count, 4) AS usage_coverage, CASE WHEN input_tokens = 0 THEN 0.0 ELSE round(cached_input_tokens / input_tokens, 4) END AS cache_hit_ratio"


@query("usage_report", f"SELECT {DERIVED_SQL} FROM (SELECT {TOTALS_SQL} FROM {USAGE_SQL})")
def q_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_totals(tables.usage_records(spark, d))


@query("usage_by_batch", f"SELECT {DERIVED_SQL} FROM (SELECT batch_id, {TOTALS_SQL} FROM {USAGE_SQL} GROUP BY batch_id)")
def q_usage_by(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_totals(tables.usage_records(spark, d), ["batch_id"])


SETS_SQL = """
    SELECT 'union' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)
    UNION ALL SELECT 'difference', count(*), sum(k)::BIGINT FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT 'intersection', count(*), sum(k)::BIGINT FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT 'distinct', count(*), sum(k)::BIGINT FROM (SELECT DISTINCT o_custkey AS k FROM orders)
"""


@query("set_ops", SETS_SQL)
def q_sets(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    orders = tables.table(spark, d, "orders")
    every, filled = orders.select(F.col("o_custkey").alias("k")), orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    total = lambda op, df: df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(op).alias("op"), "n", "total")
    return total("union", every.union(customers).distinct()).unionByName(total("difference", customers.subtract(filled))).unionByName(total("intersection", customers.intersect(filled))).unionByName(total("distinct", every.distinct()))
