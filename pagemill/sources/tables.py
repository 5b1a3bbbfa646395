"""Tables of a data directory, and the shapes that the operators work on, made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents, which are its pages in order of doc_id; see ``numbered``."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), "doc_id", "text")


def numbered(rows: DataFrame, chunk: int = ordered.CHUNK, ready: bool = False) -> DataFrame:
    """Rows of documents with their page number in place of doc_id; a source may hold most of the rows.

    It comes after what is worked out from the texts, so that no text is shuffled. ``ready``: the rows are as cheap as a scan.
    """
    return ordered.ordinal(ordered.with_chunk(rows, ["source_id"], ["doc_id"], chunk, ready), ["source_id"], ["doc_id"], "page").drop("__chunk", "doc_id")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as its pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("source_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))


def shard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the page records of a batch's shard: status, and counts from their quantities."""
    status = F.when(F.col("l_returnflag") == "A", "rebuilt").when(F.col("l_returnflag") == "N", "pending").otherwise("blocked")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("page"), status.alias("status"),
        F.col("l_quantity").cast("long").alias("block_count"), (F.col("l_partkey") % 7).alias("object_count"),
        (F.col("l_suppkey") % 3).alias("continuity_count"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).cast("long").alias("uncertainty_count"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


def ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled orders as the batches that a ledger has; their digest stands for the shard's."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("batch_id"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), 256).alias("shard_sha256"))


def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the usage that a batch (a user) reported; a view reports none."""
    props = F.from_json("props", "k INT")
    usage = F.struct(
        (props["k"].cast("long") * 10).alias("input_tokens"), props["k"].cast("long").alias("output_tokens"), F.when(F.col("event_type") == "click", props["k"].cast("long")).alias("cached_input_tokens"),
        F.lit(None).cast("long").alias("reasoning_tokens"), F.floor(F.abs("value") * 100).cast("long").alias("duration_ms"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("retry_count"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("batch_id"), F.when(F.col("event_type") != "view", usage).alias("usage"), (1 + F.col("event_id") % 3).cast("long").alias("page_count"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workflow contexts: every field of a context from the key and the market segment."""
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(of, F.lit(len(names))) + 1).cast("int"))
    key = F.col("c_custkey")
    operation = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "convert").when(F.col("c_mktsegment") == "BUILDING", "resume").when(F.col("c_mktsegment") == "FURNITURE", "refine").when(F.col("c_mktsegment") == "HOUSEHOLD", "repair").otherwise("review")
    names = ("book", "long-document", "math-heavy", "encoded-math", "cjk", "visual-complex")
    traits = F.array_compact(F.array(*[F.when((F.floor(key / 2**i) % 2) == 1, F.lit(t)) for i, t in enumerate(names)]))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("context_id"), operation.alias("operation"), pick(key, "digital", "scanned", "mixed", "unknown").alias("source_kind"), traits.alias("traits"),
        pick(F.floor(key / 3), "rough-draft", "clean-semantic", "publication-polish").alias("delivery_level"), pick(F.floor(key / 5), "one-turn", "resumable", "goal-backed").alias("execution_mode"),
        pick(F.floor(key / 7), "source-aware", "project-only").alias("verification_scope"), pick(F.floor(key / 11), "complete", "blocked", "downgraded", "in-progress").alias("outcome"),
        pick(F.floor(key / 13), "pass", "fail", "not-run").alias("compile_check"), pick(F.floor(key / 17), "pass", "not-applicable", "fail").alias("visual_review"),
        pick(F.floor(key / 19), "verified", "not-verified-by-scope", "in-progress").alias("source_fidelity"), pick(F.floor(key / 23), "go on", "", "{{NEXT}}").alias("next_action"),
        pick(F.floor(key / 29), "publication-polish", "clean-semantic", "").alias("previous_delivery"), pick(F.floor(key / 31), "approved", "").alias("downgrade_approval"),
    )


def raster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rasters of 64 samples; the label is the document."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("source_id"), F.col("vec_id").alias("page_id"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 32).cast("int")).alias("samples"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their number from 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return docs.select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages, without scheme, query and fragment."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "").alias("path"))


