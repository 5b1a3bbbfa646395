"""Benchmark decontamination by an FM-index for each shard of the training text.

Texts are lower-cased (A-Z) and cut into words. A shard is a run of documents of some
megabytes in one partition. Its words become symbols of the benchmark's vocabulary;
stretches of foreign words, which no phrase can contain, shrink to one separator, and
so do stretches of known words that are shorter than the shortest phrase. Over the
symbols stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and
sampled suffix positions. All phrases are searched backward at once through the
matrix's ranks; occurrences are located by walking to a sampled position; overlapping
removal spans are merged. No shuffle is needed.

The phrases (13 consecutive words of an item, or all of a shorter one) are sent to the
executors in blocks of at most ``block_bytes`` of item text, as arrays of about 16 bytes for each
word. With more than one block, the rows get numbers and are written to the shared folder,
each block's hits carry the row's number, and spans and items are merged by it, so the result
does not depend on the number of blocks.

Cases: a null text has no words and no hits; an item without words has no phrase; rows
that repeat a doc_id, or have none, are searched and returned each by itself; equal items all count; an
empty benchmark hits nothing; other columns are ignored. A text of any length is one part of a shard;
a task holds some 60 bytes for each byte of its known words, and 12 for each other byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import ALNUM, SLICE_BYTES, Words, flat, runs, slices, spread
from .session import written

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_SYMBOLS = 1 << 18


class WaveletMatrix:
    """Ranks over an array of symbols: one bit plane and its running counts for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes = []
        cur = symbols
        for level in reversed(range(bits)):
            bit = (cur >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            zeros = len(cur) - int(ones[-1])
            self.planes.append((level, ones, zeros))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        lo, hi = np.zeros_like(i), i
        for level, ones, zeros in self.planes:
            a, b = ones[lo], ones[hi]
            one = ((symbol >> level) & 1).astype(bool)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it stands before i."""
        symbol, lo, hi = np.zeros_like(i), np.zeros_like(i), i
        for level, ones, zeros in self.planes:
            one = (ones[hi + 1] - ones[hi]).astype(bool)
            a, b = ones[lo], ones[hi]
            symbol = symbol | (one.astype(i.dtype) << level)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return symbol, hi - lo


class FMIndex:
    """Index of symbols 1.. with 0 as separator; the text must end with a separator."""

    def __init__(self, text: np.ndarray, alphabet: int, rate: int = 8):
        n = len(text)
        sep = text == 0
        rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))  # each separator is a symbol of its own
        width = 1
        while True:
            order = np.argsort(rank, kind="stable")
            sorted_rank = rank[order]
            dense = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = dense
            if dense[-1] == n - 1:
                break
            later = np.zeros(n, np.int64)
            later[: n - width] = rank[width:] + 1
            rank = rank * (n + 1) + later
            width *= 2
        bwt = text[order - 1]  # order 0 meets the last separator
        self.matrix = WaveletMatrix(bwt.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        keep = (order % rate == 0) | (text[order - 1] == 0)
        self.kept, self.sample = np.concatenate([[0], np.cumsum(keep)]), order[keep]

    def search(self, symbols: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that start with each pattern; symbols[start:start+size] are the patterns."""
        lo = np.zeros(len(start), np.int64)
        hi = np.full(len(start), self.before[-1], np.int64)
        live = np.arange(len(start))
        for k in reversed(range(size)):
            c = symbols[start[live] + k].astype(np.int64)
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        at, steps = row.copy(), np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            live = live[self.kept[at[live] + 1] == self.kept[at[live]]]
            symbol, before = self.matrix.access(at[live])
            at[live] = self.before[symbol] + before
            steps[live] += 1
        return self.sample[self.kept[at]] + steps


class Phrases:
    """The windows of a block of items as places in their symbols, and the items of each window."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int = WINDOW):
        words = Words(*flat(texts), ALNUM)
        self.vocabulary, symbol = np.unique(words.hash, return_inverse=True)
        self.sequence = (symbol + 1).astype(np.int32)
        size = np.minimum(window, words.count)
        #: For each size: where its different windows start, where the owners of each begin, and the owners.
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size[size > 0]).tolist():
            item = np.flatnonzero(size == n)
            each = words.count[item] - n + 1
            start = spread(words.first[item], each)
            order, new = self._alike(start, n)
            first = np.flatnonzero(new)
            self.sizes[n] = start[order][first].astype(np.int32), np.append(first, len(start)).astype(np.int64), np.repeat(item, each)[order].astype(np.int32)
        self.items = ids
        self.least = min(self.sizes, default=0)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _alike(self, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """An order that brings equal windows together, and where another window begins; a chance meeting of hashes only repeats a window."""
        h = np.zeros(len(start), np.uint64)
        for k in range(n):
            h = (h ^ self.sequence[start + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        own = start[order]
        new = np.ones(len(own), bool)
        if len(own) > 1:
            same = np.ones(len(own) - 1, bool)
            for k in range(n):
                same &= self.sequence[own[1:] + k] == self.sequence[own[:-1] + k]
            new[1:] = ~same
        return order, new

    def symbols(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        near = np.flatnonzero(self.quick[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[near])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == h[near]
        out[near[same]] = at[same] + 1
        return out


class Shard:
    """Symbols of some documents: stretches of known words, with a separator after each."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.size = phrases, 0
        self.symbols: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.n_words: list[np.ndarray] = []
        self.where: list[tuple[np.ndarray, np.ndarray]] = []
        self.total = 0

    def add(self, data: np.ndarray, off: np.ndarray) -> None:
        words = Words(data, off, ALNUM)
        symbol = self.phrases.symbols(words.hash)
        cut = np.zeros(len(symbol) + 1, bool)
        cut[words.first] = True
        start, stop = runs(symbol > 0)
        if len(start):  # a stretch also ends where a document does
            inner = np.flatnonzero(cut[:-1] & (symbol > 0))
            inner = inner[~np.isin(inner, start)]
            start, stop = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([stop, inner]))
        long = stop - start >= max(1, self.phrases.least)
        start, stop = start[long], stop[long]
        at = spread(start, stop - start + 1)
        if len(at):
            ends = np.cumsum(stop - start + 1) - 1
            out = symbol[np.minimum(at, len(symbol) - 1)]
            out[ends] = 0
            self.symbols.append(out)
            self.word.append(at + self.total)
            self.size += len(out)
        self.n_words.append(words.count)
        self.where.append((words.start, words.stop))
        self.total += len(symbol)

    def hits(self) -> list[tuple[int, list, list]]:
        """For each document its number of words, merged spans of hit words and the items found (as places in the block)."""
        count = np.concatenate(self.n_words)
        first = np.concatenate([[0], np.cumsum(count)])
        spans: list[list] = [[] for _ in count]
        items: list[set] = [set() for _ in count]
        if self.size and self.phrases.sizes:
            text, word = np.concatenate(self.symbols), np.concatenate(self.word)
            index = FMIndex(text, len(self.phrases.vocabulary))
            edge = np.zeros(self.total + 1, np.int64)
            for size, (pattern, begin, owners) in self.phrases.sizes.items():
                lo, hi = index.search(self.phrases.sequence, pattern, size)
                found = np.flatnonzero(hi > lo)
                row = spread(lo[found], (hi - lo)[found])
                at = word[index.locate(row)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                which = np.repeat(found, (hi - lo)[found])
                pair = np.unique((np.searchsorted(first, at, side="right") - 1) * len(pattern) + which)
                for doc, w in zip((pair // len(pattern)).tolist(), (pair % len(pattern)).tolist(), strict=True):
                    items[doc].update(owners[begin[w] : begin[w + 1]].tolist())
            hit = np.cumsum(edge[:-1]) > 0
            start, stop = runs(hit)
            inner = np.setdiff1d(first[(first > 0) & (first < self.total)], start)
            inner = inner[hit[inner] & hit[inner - 1]] if len(inner) else inner  # hits of neighbours in the shard are apart
            start, stop = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([stop, inner]))
            doc = np.searchsorted(first, start, side="right") - 1
            for d, a, b in zip(doc.tolist(), (start - first[doc]).tolist(), (stop - first[doc]).tolist(), strict=True):
                spans[d].append((a, b))
        return [(int(n), s, sorted(i)) for n, s, i in zip(count, spans, items, strict=True)]


SCHEMA = "doc_id long, row long, n_words long, spans array<struct<start:long,stop:long>>, item_ids array<long>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The number of blocks, and the items in blocks of about block_bytes of text; an item is the largest thing that is held at once."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return n, (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n))


def search_block(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """What one block's phrases hit in each of ``rows (doc_id, text, row)``; no shuffle."""
    got = items.toArrow().sort_by("item_id")  # at most a block, checked by the caller
    sent = rows.sparkSession.sparkContext.broadcast(Phrases(got.column("item_id").combine_chunks(), got.column("text").combine_chunks(), window))

    def run(batches):
        phrases = sent.value
        for batch in batches:
            data, off = flat(batch.column(1))
            shard, first = Shard(phrases), 0
            for i, j in slices(off, SLICE_BYTES):
                shard.add(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if shard.size >= SHARD_SYMBOLS or j == batch.num_rows or off[j] - off[first] >= 8 * SLICE_BYTES:
                    n_words, spans, owners = zip(*shard.hits(), strict=True)
                    edge = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int32)
                    names = phrases.items.take(pa.array([x for o in owners for x in o], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, j - first), batch.column(2).slice(first, j - first), pa.array(n_words, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], SPANS), pa.ListArray.from_arrays(pa.array(edge), names)],
                        ["doc_id", "row", "n_words", "spans", "item_ids"],
                    )
                    shard, first = Shard(phrases), j

    return rows.mapInArrow(run, SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_row: str | None = None) -> DataFrame:
    """``doc_id, n_words, spans, item_ids`` of each row of ``docs``: spans of hit words (merged, as word numbers) and the items that occur.

    ``keep_row`` names a column of row numbers that the result repeats as ``row``.
    """
    n, parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(keep_row).cast("long").alias("row") if keep_row else F.lit(0).cast("long").alias("row"))
    columns = ["doc_id", *(["row"] if keep_row else []), "n_words", "spans", "item_ids"]
    if n == 1:
        return search_block(rows, next(parts), window).select(columns)
    # row numbers must stay the same from block to block: they are written with the rows
    rows = written(rows.select("doc_id", "text", F.struct(F.monotonically_increasing_id().alias("no"), F.col("row").alias("kept")).alias("row")))
    numbered = rows.select("doc_id", "text", F.col("row.no").alias("row"))
    found = None
    for items in parts:
        part = search_block(numbered, items, window)
        found = part if found is None else found.unionByName(part)
    both = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids"))), asc=True).alias("item_ids"))
    empty = F.array().cast("array<struct<start:long,stop:long>>")

    def join_span(acc, x):
        tail = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(tail["start"].alias("start"), F.greatest(tail["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(-1)) >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    merged = both.select("row", "doc_id", "n_words", F.aggregate("s", empty, join_span).alias("spans"), "item_ids")
    if keep_row:
        names = rows.select(F.col("row.no").alias("no"), F.col("row.kept").alias("kept"))
        merged = merged.join(names, F.col("row") == F.col("no")).withColumn("row", F.col("kept"))
    return merged.select(columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of whose words less than one in ``share`` is hit, or none; each row is judged by its own text."""
    n, parts = blocks(benchmark, "item_id", "text", block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    if n > 1:
        rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
        found = find_contamination(rows.withColumn("__none", F.lit(None).cast("long")), benchmark, window, block_bytes, "__none", text_col, keep_row="__row")
        gone = found.where((hit > 0) & (share * hit >= F.col("n_words"))).select(F.col("row").alias("__row"))
        return rows.join(gone, "__row", "left_anti").drop("__row")
    got = next(parts).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(got.column("item_id").combine_chunks(), got.column("text").combine_chunks(), window))
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(place))
            keep, shard = np.ones(batch.num_rows, bool), Shard(sent.value)
            first = 0
            for i, j in slices(off, SLICE_BYTES):
                shard.add(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if shard.size >= SHARD_SYMBOLS or j == batch.num_rows or off[j] - off[first] >= 8 * SLICE_BYTES:
                    for k, (n_words, spans, _) in enumerate(shard.hits(), first):
                        n_hit = sum(b - a for a, b in spans)
                        keep[k] = not (n_hit and share * n_hit >= n_words)
                    shard, first = Shard(sent.value), j
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
