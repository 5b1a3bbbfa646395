"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. Each chunk has a polynomial hash modulo two
primes, ``H(c) = sum (c[i] + 1) * B**(len - 1 - i)``. Chunks of one text combine by
length-shifted arithmetic, ``H(xy) = H(x) * B**len(y) + H(y)``, so a chunk that is
followed by ``t`` bytes adds ``H(c) * B**t``: a plain sum that any tasks can share and
that is summed before the shuffle. The chunks of a huge text (more than ``SPREAD`` of them) are dealt
out and hashed by many tasks; only its SHA-256 has to be worked out where it is read.

Texts with equal fingerprint and length are then compared chunk by chunk: chunk
contents are grouped as they stream by, equal contents fold into one before the
shuffle, and a fingerprint of which all chunk numbers have one content is proved.
Where contents differ, texts are told apart by the contents' ranks.

Cases: a null text counts as empty; empty texts are copies of each other; rows that
repeat doc_id and text are one document and share a verdict; of equal texts the row
with the largest doc_id stays (a null doc_id never wins unless all are null). An empty
table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat
from .session import cut

CHUNK_BYTES = 1 << 16
SPREAD = 16
#: Primes and bases of the two hashes.
FIELDS = ((2147483647, 1664525347), (2147483629, 1103515245))


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime, by squaring."""
    out, square, e = np.ones(len(exponents), np.uint64), base % prime, exponents.astype(np.uint64)
    while len(e) and e.any():
        odd = (e & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(square) % np.uint64(prime)
        square, e = square * square % prime, e >> np.uint64(1)
    return out


def chunk_hash(data: np.ndarray, off: np.ndarray, prime: int, base: int, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of each data[off[i]:off[i+1]]; chunks of up to 2**24 bytes."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        if table is None or len(table) < n.max():
            table = power(base, np.arange(n.max()), prime)
        exponent = np.repeat(off[1:] - 1, n) - np.arange(off[-1])
        terms = (data.astype(np.uint64) + np.uint64(1)) * table[exponent]
        out[full] = np.add.reduceat(terms, off[:-1][full]) % np.uint64(prime)
    return out


def combine(left: int, right: int, right_bytes: int, prime: int, base: int) -> int:
    """Hash of xy from the hashes of x and y."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fields=FIELDS) -> DataFrame:
    """One row per input row: ``id, text_sha256, n_bytes, h1, h2``.

    ``docs`` must be a table scan or another plan that gives the same rows in the same
    order when it is run again.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), raw.alias("raw"))
    rows = rows.select("row", "id", F.octet_length("raw").cast("long").alias("n_bytes"), "raw")
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / chunk_bytes).cast("long"))
    begin = F.col("no") * chunk_bytes

    def chunks(texts: DataFrame) -> DataFrame:
        each = texts.select("row", "id", F.sha2("raw", 256).alias("text_sha256"), "n_bytes", "raw", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no"))
        return each.select(
            "row", "id", "text_sha256", "n_bytes",
            F.greatest(F.lit(0).cast("long"), F.col("n_bytes") - begin - chunk_bytes).alias("tail"),
            F.substring(F.col("raw"), (begin + 1).cast("int"), F.lit(chunk_bytes)).alias("chunk"),
        )

    huge = F.col("n_bytes") > SPREAD * chunk_bytes
    parts = chunks(rows.where(~huge)).unionByName(chunks(rows.where(huge)).repartition("row", "tail"))

    def hash_parts(batches):
        tables = [power(base, np.arange(chunk_bytes), prime) for prime, base in fields]
        for batch in batches:
            data, off = flat(batch.column(5))
            tail = batch.column(4).to_numpy(zero_copy_only=False)
            later, where = np.unique(tail, return_inverse=True)
            shifted = []
            for (prime, base), table in zip(fields, tables, strict=True):
                h, step = np.zeros(len(tail), np.uint64), 256
                for i in range(0, len(tail), step):  # a few megabytes at a time
                    o = off[i : i + step + 1]
                    h[i : i + step] = chunk_hash(data[o[0] : o[-1]], o - o[0], prime, base, table)
                shifted.append((h * power(base, later, prime)[where] % np.uint64(prime)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), *map(pa.array, shifted)], ["row", "id", "text_sha256", "n_bytes", "h1", "h2"])

    id_type = docs.schema[id_col].dataType.simpleString()
    hashed = parts.mapInArrow(hash_parts, f"row long, id {id_type}, text_sha256 string, n_bytes long, h1 long, h2 long")
    sums = [(F.sum(h) % p).alias(h) for h, (p, _) in zip(("h1", "h2"), fields, strict=True)]
    return hashed.groupBy("row", "id", "text_sha256", "n_bytes").agg(*sums).drop("row")


#: Rows of one group of copies go to so many tasks when they get the group's figures.
SALTS = 32


def _salted(groups: DataFrame) -> DataFrame:
    """A group's row for each salt; only groups of copies are repeated so."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fields=FIELDS) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256, n_bytes, h1, h2``, one row per input row."""
    key = ["n_bytes", "h1", "h2"]
    prints = cut(fingerprints(docs, id_col, text_col, chunk_bytes, fields))
    salt = F.pmod(F.xxhash64("id", "text_sha256"), F.lit(SALTS)).cast("int").alias("salt")
    shared = prints.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1").drop("copies")

    # chunkwise comparison of the texts whose fingerprints meet
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    texts = docs.select(F.col(id_col).alias("id"), raw.alias("raw")).withColumn("text_sha256", F.sha2("raw", 256))
    suspects = prints.select("*", salt).join(_salted(shared), [*key, "salt"]).select("id", "text_sha256", *key).distinct()
    suspects = suspects.withColumnRenamed("id", "sid").withColumnRenamed("text_sha256", "ssha")
    met = texts.join(suspects, F.col("id").eqNullSafe(F.col("sid")) & (F.col("text_sha256") == F.col("ssha")))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / chunk_bytes).cast("long"))
    chunks = met.select("id", "text_sha256", *key, "raw", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no"))
    chunks = chunks.select("id", "text_sha256", *key, "no", F.substring(F.col("raw"), (F.col("no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)).alias("chunk"))
    contents = chunks.groupBy(*key, "no", "chunk").agg(F.min("text_sha256").alias("one"))
    unlike = cut(contents.groupBy(*key, "no").agg(F.count("*").alias("contents")).where("contents > 1").select(key).distinct())
    if unlike.isEmpty():
        classes = prints.withColumn("mark", F.lit(""))
    else:  # fingerprints that met by chance: tell the texts apart by the ranks of their chunks' contents
        from pyspark.sql import Window

        ranked = contents.join(unlike, key).withColumn("rank", F.dense_rank().over(Window.partitionBy(*key, "no").orderBy("chunk")))
        marks = chunks.join(ranked.select(*key, "no", "chunk", "rank"), [*key, "no", "chunk"])
        marks = marks.select("text_sha256", *key, "no", "rank").distinct().groupBy("text_sha256", *key)
        marks = marks.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "rank"))), lambda x: x["rank"].cast("string")), ",").alias("mark"))
        classes = prints.join(marks, ["text_sha256", *key], "left").withColumn("mark", F.coalesce("mark", F.lit("")))
    groups = classes.groupBy(*key, "mark").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = classes.select("*", salt).join(_salted(groups), [*key, "mark", "salt"], "left")
    alone = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(alone, F.col("id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *key)
