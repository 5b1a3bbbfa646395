"""Compression of vectors to product codes, with annular pruning by norms.

A vector's components become integers ``floor(scale * x)``; it is cut into equal consecutive
parts, and each part position has a codebook. The nearest entry of a part is searched in its
codebook sorted by norm: a first entry, the one whose norm is closest, gives a distance d, and
any entry at distance d or less has a norm within d of the part's own (triangle inequality). That
interval of the sorted norms is found by binary search, its ends included and widened by more
than the rounding of a square root, and only its entries are compared, in exact integers.

The codebooks are learnt by rounds of assignment and integer means. A round is one pass
over the written integers: each task sums what it has by part and entry, the sums are added up by
Spark, and the new codebooks (parts x entries rows, whatever the input) go out with the next pass.

Cases: rows whose vector is null or holds null or non-finite components are dropped. Rows that
repeat a ``vec_id`` are separate rows; null ids come last in the order of ids; equal ids are
ordered by their vectors. With fewer vectors than entries, a codebook has one entry for each. A
vector whose length is not that of the first one gets null as code, error and label error, and no
part in the codebooks. A length that the parts don't divide, or components beyond the range in
which distances are exact (2**26 after scaling, for parts of up to 256), are a ValueError. An
empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import spread
from .session import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 26
#: Vectors compared at once.
CHUNK = 4096


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        norm = np.sqrt((self.entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry of each row of ``x`` (ties: the lowest), its squared distance, and how many entries were compared."""
        r = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        above = np.clip(np.searchsorted(self.norm, r), 0, len(self.norm) - 1)
        below = np.maximum(above - 1, 0)
        first = np.where(np.abs(self.norm[below] - r) < np.abs(self.norm[above] - r), below, above)
        best = ((x - self.entries[self.order[first]]) ** 2).sum(1)
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (reach + r) + 1e-6  # more than the square roots can be off
        low = np.searchsorted(self.norm, r - reach - slack, side="left")
        high = np.searchsorted(self.norm, r + reach + slack, side="right")
        size = high - low  # one at least: the first entry
        row = np.repeat(np.arange(len(x)), size)
        entry = self.order[spread(low, size)]
        far = ((x[row] - self.entries[entry]) ** 2).sum(1)
        at = np.cumsum(size) - size
        least = np.minimum.reduceat(far, at) if len(x) else far
        index = np.minimum.reduceat(np.where(far == least[row], entry, len(self.norm)), at) if len(x) else entry
        return index, least, len(row)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``vec_id, label, q``: the kept rows, with integer components."""
    x = F.col(vector_col)
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), q.alias("q"))


def rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``width`` components as a matrix, and which rows they are."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(size == width)
    values = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), width)
    return values, own


def learn(q: DataFrame, width: int, first: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` rounds, from those whose entries are the parts of ``first``: [part, entry, component]."""
    step = width // parts
    books = first.reshape(len(first), parts, step).transpose(1, 0, 2).astype(np.int64)
    entries = len(first)

    def summed(books):
        def run(batches):
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                values, _ = rows_of(batch.column(0), width)
                for p in range(parts):
                    book = Codebook(books[p])
                    for i in range(0, len(values), CHUNK):
                        x = values[i : i + CHUNK, p * step : (p + 1) * step]
                        index, _, _ = book.nearest(x)
                        order = np.argsort(index, kind="stable")
                        met, at = np.unique(index[order], return_index=True)
                        sums[p, met] += np.add.reduceat(x[order], at, axis=0)
                        counts[p] += np.bincount(index, minlength=entries)
            used = np.argwhere(counts > 0)
            lists = pa.array([sums[p, e].tolist() for p, e in used], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array(counts[counts > 0]), lists], ["part", "entry", "n", "sums"])

        return run

    add = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(step)]
    for _ in range(rounds):
        shares = q.select("q").mapInArrow(summed(books), "part int, entry int, n long, sums array<long>")
        # a row for each part and entry: 128 with the defaults
        found = shares.groupBy("part", "entry").agg(F.sum("n").alias("n"), *add).collect()
        books = books.copy()
        for row in found:
            books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(step)]
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code (binary, an index for each part), error`` of the kept rows, and the codebooks: [part, entry, component]."""
    q = written(integers(vectors, id_col, vector_col, label_col, scale))
    if entries > 256:
        raise ValueError("an index must fit in a byte")
    head = q.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).collect()
    width = len(head[0]["q"]) if head else 0
    if width % parts or width // parts > 256:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts of at most 256")
    own = q.where(F.size("q") == width)
    most = own.agg(F.max(F.greatest(F.array_max("q"), -1 - F.array_min("q")))).first()[0]
    if most is not None and most >= LIMIT:
        raise ValueError(f"components of {most} after scaling: squared distances would not be exact")
    least = own.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    first = np.array([r["q"] for r in least], np.int64).reshape(len(least), width)
    books = learn(own, width, first, parts, rounds) if width else np.zeros((parts, len(first), 0), np.int64)
    step = width // parts

    def run(batches):
        sorted_books = [Codebook(b) for b in books]
        for batch in batches:
            values, rows = rows_of(batch.column(2), width)
            code, error = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
            for i in range(0, len(values) if width else 0, CHUNK):
                for p, book in enumerate(sorted_books):
                    index, least, _ = book.nearest(values[i : i + CHUNK, p * step : (p + 1) * step])
                    code[i : i + CHUNK, p] = index
                    error[i : i + CHUNK] += least
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for k, c, e in zip(rows.tolist(), code, error.tolist(), strict=True):
                codes[k], errors[k] = c.tobytes(), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = q.schema["label"].dataType.simpleString()
    return q.mapInArrow(run, f"vec_id long, label {kind}, code binary, error long"), books


def by_label(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels (nulls together)."""
    coded = written(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same_label")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same_label")), "left").drop("same_label")
    return joined.withColumn("label_error", F.when(F.col("error").isNotNull(), F.col("label_error")))
