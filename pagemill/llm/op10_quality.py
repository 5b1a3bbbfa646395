"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model is over bytes, with n-grams of ``ORDER`` = 4. It is trained on trusted text: documents
that ``labels.quality`` marks 1. Tasks count the n-grams of what they read; a grouped sum
joins the counts, which stay in shards of the n-gram. Lower orders count continuations. Discounts for
counts of one, two and three or more come from the counts of counts of each order. Only the
counts of counts and the two lowest orders, at most 65,536 rows, reach the driver.

Documents are scored by joins with the sharded counts. A slice of documents (some megabytes) asks for
each of its n-grams once; the n-grams that any slice asks for get their probability by one join for
each order with the shares of n-grams and one with the masses of contexts; the answers
go back to their slices, whose bytes they meet again there. A document's perplexity has ``weight`` bytes
of average trusted text added, so that a few characters cannot decide. A document is kept if its
perplexity is no more than ``slack`` times the trusted documents' ``quantile`` in its language.

All trusted rows and all n-grams are counted; every row is scored whole. Nothing is sent everywhere but
the 65,536 rows, a bit map of 1 MB, and thresholds of at most ``MAX_LANGS`` languages. ``docs`` must be a
table scan or another plan that gives the same rows in the same order when it is run again; a slice that
meets other answers than it asked for stops with an error.

Cases: null and empty texts have the perplexity of average trusted text and are kept;
a null language is a language of its own; one without trusted documents has the threshold of
all trusted documents together; without any trusted text the model is uniform and keeps all;
rows that repeat, or have a null doc_id, are scored each by itself; a text of any length is one slice, and a task
holds some 50 bytes for each of its bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import maybe_in
from .bytes_np import flat, slices
from .session import cut, written

ORDER = 4
SLICE = 4 << 20  # bytes of documents that ask together
MAX_LANGS = 10_000  # up to so many languages their thresholds are sent to every task
GRID = 1000  # steps of log10 perplexity in the histograms that quantiles are read from


def grams(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; line feeds stand before each text."""
    size, front = np.diff(off), order - 1
    padded = np.full(int(off[-1]) + front * len(size), 10, np.uint8)
    keep = np.ones(len(padded), bool)
    keep[((off[:-1] + front * np.arange(len(size)))[:, None] + np.arange(front)).ravel()] = False
    padded[keep] = data
    g = padded.astype(np.int64)
    for k in range(1, order):
        g[k:] |= padded[:-k].astype(np.int64) << 8 * k
    return g[keep]


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram long, n long`` over all texts."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(0))
            for i, j in slices(off):
                gram, n = np.unique(grams(data[off[i] : off[j]], off[i : j + 1] - off[i]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    return docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(t: list[int]) -> list[float]:
    """Discount for a count of 1, 2, 3 and more, from how many n-grams have a count of 1, 2, 3, 4 (modified Kneser-Ney)."""
    if not t[0] or not t[1]:
        return [0.5, 0.75, 0.9]
    y = t[0] / (t[0] + 2 * t[1])
    d = [k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]


def suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def interpolation(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``gram, share`` (its discounted part of its context) and ``context, mass`` (what is left for the lower order)."""
    n = F.col("n")
    t = counts.agg(*(F.coalesce(F.sum((n == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4))).first()
    d1, d2, d3 = discounts(list(t))
    d = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    own = counts.select("gram", context(F.col("gram")).alias("context"), "n", d.alias("d"))
    sums = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    share = own.join(sums, "context").select("gram", ((n - F.col("d")) / F.col("total")).alias("share"))
    return share, sums.select("context", (F.col("left") / F.col("total")).alias("mass"))


def lower_order(counts: DataFrame, order: int) -> DataFrame:
    """How many n-grams end in each shorter one."""
    return counts.groupBy(suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n"))


def two_bytes(counts: DataFrame) -> np.ndarray:
    """The probability of each byte after each byte, under the two lowest orders."""
    rows = counts.toArrow()  # at most 65,536
    gram, n = (rows.column(k).to_numpy() for k in ("gram", "n"))

    def level(of, n, size):
        t = [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)]
        d = np.array([0, *discounts(t)])[np.minimum(n, 3)]
        total, left = np.bincount(of, n, minlength=size), np.bincount(of, d, minlength=size)
        return (n - d) / total[of], np.where(total > 0, left / np.maximum(total, 1), 1.0)

    one, n1 = np.unique(gram & 255, return_counts=True)
    p1 = np.full(256, 1 / 256)
    if len(one):
        share, mass = level(np.zeros(len(one), np.int64), n1, 1)
        p1 *= mass[0]
        p1[one] += share
    p2 = np.tile(p1, 256)
    if len(gram):
        share, mass = level(gram >> 8, n, 256)
        p2 *= np.repeat(mass, 256)
        p2[gram] += share
    return p2


class Model:
    """Counts of the orders above two in shards, and a table of the two lowest."""

    def __init__(self, trusted: DataFrame, text_col: str = "text"):
        self.counts = {ORDER: cut(count_grams(trusted, text_col))}
        for m in range(ORDER - 1, 1, -1):
            self.counts[m] = lower_order(self.counts[m + 1], m)
            if m > 2:
                self.counts[m] = cut(self.counts[m])
        self.low = two_bytes(self.counts[2])

    def log10(self, asked: DataFrame) -> DataFrame:
        """``gram, log10`` of each of the n-grams asked for."""
        need = {ORDER: asked.select("gram").distinct()}
        for m in range(ORDER - 1, 2, -1):
            need[m] = need[m + 1].select(suffix(F.col("gram"), m).alias("gram")).distinct()
        low = F.broadcast(asked.sparkSession.createDataFrame(list(enumerate(self.low.tolist())), "lower long, p_low double"))
        for m in range(3, ORDER + 1):
            share, mass = interpolation(self.counts[m])
            rows = need[m].select("gram", context(F.col("gram")).alias("context"), suffix(F.col("gram"), m - 1).alias("lower"))
            rows = rows.join(low, "lower").join(share, "gram", "left").join(mass, "context", "left")
            p = F.coalesce("share", F.lit(0.0)) + F.coalesce("mass", F.lit(1.0)) * F.col("p_low")
            low = cut(rows.select(F.col("gram").alias("lower"), p.alias("p_low")))
        return low.select(F.col("lower").alias("gram"), F.log10("p_low").alias("log10"))


def _sliced(batches, column: int, slice_bytes: int):
    """Slices of the batches of a partition, with numbers that are the same whenever the partition is read."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, off = flat(batch.column(column))
        for i, j in slices(off, slice_bytes):
            yield number, batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            number += 1


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def perplexities(docs: DataFrame, model: Model, weight: int = 200, slice_bytes: int = SLICE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (without the text) with ``n_bytes, perplexity``."""
    others = [c for c in docs.columns if c != text_col]
    rows, place = docs.select(*others, text_col), len(others)
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ["n_bytes long", "perplexity double"])

    def asks(batches):
        for number, _, data, off in _sliced(batches, place, slice_bytes):
            kinds = [np.unique(grams(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off)]
            gram = np.unique(np.concatenate(kinds)) if kinds else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), number)), pa.array(gram)], ["slice", "gram"])

    def texts(batches):
        for number, batch, _, _ in _sliced(batches, place, slice_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_packed(batch)], pa.binary())], ["slice", "packed"])

    asked = written(rows.mapInArrow(asks, "slice long, gram long"))
    known = cut(model.log10(asked))
    top = model.counts[ORDER].join(known, "gram").agg(F.sum(F.col("n") * F.col("log10")).alias("s"), F.sum("n").alias("n")).first()
    typical = top["s"] / top["n"] if top["n"] else -float(np.log10(256))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        gram, log10 = (right.column(c).to_numpy() for c in ("gram", "log10"))
        order = np.argsort(gram)
        gram, log10 = gram[order], log10[order]
        out = []
        for packed in left.column("packed").to_pylist():
            for batch in pa.ipc.open_stream(packed):
                data, off = flat(batch.column(place))
                total = np.zeros(batch.num_rows)
                for i, j in slices(off):
                    own = grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    at = np.minimum(np.searchsorted(gram, own), max(0, len(gram) - 1))
                    if len(own) and not (len(gram) and (gram[at] == own).all()):
                        raise ValueError("a slice has other rows than when it asked: write the documents first")
                    run_sum = np.concatenate([[0], np.cumsum(log10[at])]) if len(own) else np.zeros(1)
                    total[i:j] = run_sum[off[i + 1 : j + 1] - off[i]] - run_sum[off[i:j] - off[i]]
                size = np.diff(off)
                ppl = 10 ** (-(total + weight * typical) / (size + weight))
                out.append(pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(size), pa.array(ppl)], [*others, "n_bytes", "perplexity"]))
        return pa.Table.from_batches(out)

    answers = asked.join(known, "gram").select("slice", "gram", "log10")
    return rows.mapInArrow(texts, "slice long, packed binary").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(meet, schema)


def quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """``lang, limit``: the quantile of perplexity of the rows of each language, read from exact counts on a fine grid; null stands for all."""
    step = F.floor(F.log10("perplexity") * GRID).cast("long")
    grid = rows.select("lang", step.alias("step")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    grid = grid.select("lang", F.lit(False).alias("every"), "step", "n").unionByName(grid.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("every"), "step", "n"))
    # at most a few thousand steps of a language
    packed = grid.groupBy("lang", "every").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("g"), F.sum("n").alias("total"))
    first = F.element_at(F.filter(F.transform(F.sequence(F.lit(1), F.size("g")), lambda i: F.struct(F.element_at("g", i)["step"].alias("step"), F.aggregate(F.slice("g", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("upto"))), lambda s: s["upto"] >= F.col("total") * quantile), 1)["step"]
    return packed.select("lang", "every", F.pow(F.lit(10.0), (first + 1) / GRID).alias("limit"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05, weight: int = 200) -> DataFrame:
    """``doc_id, lang, n_bytes, perplexity, threshold, kept`` of every row."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id"), F.xxhash64("doc_id").alias("hash")).distinct()
    # the map keeps most other texts out of the join's shuffle
    marked = maybe_in(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")), good, "hash")
    model = Model(marked.join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi").select("text"))
    scored = cut(perplexities(docs.select("doc_id", "lang", "text"), model, weight))
    limits = quantiles(scored.join(good, F.col("doc_id") == F.col("good_id"), "left_semi"), quantile)
    own = limits.where("not every").select(F.col("lang").alias("l"), F.col("limit").alias("own"))
    every = limits.where("every").select(F.col("limit").alias("all_limit"))
    # both have a row for each language at most
    langs = scored.select("lang").distinct().join(own, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(every), F.lit(True), "left")
    langs = langs.select(F.col("lang").alias("l"), (slack * F.coalesce("own", "all_limit", F.lit(float("inf")))).alias("threshold"))
    if scored.select("lang").distinct().limit(MAX_LANGS + 1).count() <= MAX_LANGS:
        langs = F.broadcast(langs)  # a language may hold most rows, so its rows stay where they are
    out = scored.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left")
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
