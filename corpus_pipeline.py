"""A training corpus from the table of documents, in five stages.

Each stage takes all rows that the one before it kept, and is written as Parquet and read
again. ``run`` applies them to ``documents``.

1. toxicity: documents that the classifier marks toxic go; null and empty texts stay or go by the
   classifier's intercept, as any text without known words.
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. near dedup: of each group of near-duplicates the row with the least doc_id stays. Texts are near if
   their sets of five-word shingles have a Jaccard similarity of 0.8 or more, which is computed; SimHash
   and MinHash only propose.
4. decontamination: documents that the benchmark contaminates (a twentieth of the words or more) go.
5. packing: all tokens that are left, as pieces of training sequences.

A row is judged by itself: what goes is told by doc_id (null is a value like any other) and the hash of the
text, never by doc_id alone. Of rows that repeat both, the dedup stages keep one. Columns beside the text
are kept up to the last stage, whatever their names; names that begin with two underscores are the
stages' own. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import near_copies, op01_packing, op02_exact_dedup, op04_decontamination, op06_toxicity
from pagemill.llm.queries import vocabulary
from pagemill.llm.session import cut, ensure_checkpoint_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stay(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found (doc_id, text_sha256, kept)`` keeps; of rows that repeat both, one."""
    key = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")]
    same = lambda a, b: a["doc_id"].eqNullSafe(b["__id"]) & (near_copies.sha() == b["__sha"])
    gone = found.where("not kept").select(key).distinct()
    left = docs.join(gone, same(docs, gone), "left_anti")
    repeated = cut(found.where("kept").groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    if repeated.isEmpty():
        return left
    single = left.join(repeated, same(left, repeated), "left_anti")
    return single.unionByName(left.join(repeated, same(left, repeated)).dropDuplicates(["__id", "__sha"]).select(docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op02_exact_dedup.exact_duplicates(docs)
    return stay(docs, found.select(F.col("id").alias("doc_id"), "text_sha256", "kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stay(docs, cut(near_copies.near_copies(docs, size=5)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_packing.pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL has no classifier and no tokenizer; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
