"""Audit of how filters interact, by adjacent transpositions.

Every document is judged by all filters at once: a mask of the ones that it fails. Counts of
documents by part and mask, the mask cells, hold all that any order of the filters does. All orders
of the filters are visited so that each differs from the one before in one swap of neighbours
(plain changes), and after a swap only the two steps that it touches are worked out anew, from
the cells; the other steps keep their counts. A filter's Shapley sum accumulates along the
walk. Cells of many parts are walked at once, as columns of arrays.

Texts are judged in one pass over Arrow buffers; what is shuffled is a row of some 60 bytes for
each document (id, part, mask, SHA-256 of the text), never a text.

Cases: null texts are empty; an empty text fails A, and B and C compare zero with zero and pass.
A null part counts as the empty string. Copies are judged over the whole table: a document fails E
if an equal text has a smaller doc_id, so rows that repeat both the id and the text all pass, or all
fail. A row without an id is no one's copy and has no labels. Labels that repeat a doc_id
count once: the document is good or toxic if one of them says so. An empty table has no parts and
gives an empty result. Extra columns are not looked at. A text of any length is judged whole, its
words in parts of a megabyte that end at white space; what grows is the set of its different words.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat
from .session import written

LETTERS = "ABCDE"
UPPER = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))
MARKS = b"#$%&*|"
WORD_PART = 1 << 20
BLANK = re.compile(rb"[\x09-\x0D\x20]")
#: Places over which a group of equal texts is dealt.
SALT = 32
#: Parts whose result rows leave a task in one batch.
PARTS_AT_ONCE = 64


def count_words(text: bytes) -> tuple[int, int]:
    """Words between white space, and different ones."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        stop = BLANK.search(text, at + WORD_PART)
        to = stop.start() if stop else len(text)
        words = text[at:to].split()
        n += len(words)
        seen.update(words)
        at = to
    return n, len(seen)


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text fails."""
    n, different = count_words(text)
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUED))
    fails = (n < 50, 100 * different < 65 * n, 100 * upper > 5 * points, len(text.translate(None, MARKS)) < len(text))
    return sum(1 << k for k, bad in enumerate(fails) if bad)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, mask, sha``: each row's failures of A to D, and the SHA-256 of its text."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            raw = data.tobytes() if batch.num_rows else b""
            mask, sha = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = raw[a:b]
                mask.append(failures(text))
                sha.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(sha, pa.binary())], ["doc_id", "part", "mask", "sha"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), text_col).mapInArrow(run, "doc_id long, part string, mask int, sha binary")


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and by what they fail, E included."""
    # of most texts there is one; the least id of each of the others folds its copies before the shuffle
    least = rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1").select(F.col("sha").alias("copied"), "least")
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.join(said, F.col("doc_id") == F.col("labelled"), "left")
    # a group of copies may hold a third of all rows: its least id is sent to SALT places, its rows are dealt to them
    every = least.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    whole = dealt.join(every, (F.col("sha") == F.col("copied")) & (F.col("salt") == F.col("place")), "left")
    e = F.when(F.col("doc_id") > F.col("least"), 1 << LETTERS.index("E")).otherwise(0)
    return whole.groupBy("part", (F.col("mask") + e).alias("mask")).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """The places k whose items (k, k+1) are swapped, one after the other, to visit all n! orders.

    The largest item goes through the others from end to end, and between two of its ways the others take one step of their own walk.
    """
    if n < 2:
        return
    down = True
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the largest item now stands first, or last
        down = not down


class Walk:
    """The steps of all orders, for the mask cells of some parts: ``n, good, toxic`` are [parts, 2**filters]."""

    def __init__(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int):
        self.tables, self.filters = np.stack([n, good, toxic]), filters
        self.masks = np.arange(1 << filters)
        self.fails = [self.masks >> f & 1 == 1 for f in range(filters)]

    def step(self, f: int, before: int) -> np.ndarray:
        """What filter ``f`` removes after those of the mask ``before``: [n, good and toxic of each part]."""
        return self.tables[:, :, self.fails[f] & (self.masks & before == 0)].sum(2)

    def run(self) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
        """Each order with the removals of its steps; after the last, ``shapley`` holds the sums by filter."""
        order = list(range(self.filters))
        removed = [self.step(f, sum(1 << g for g in order[:k])) for k, f in enumerate(order)]
        self.shapley = [removed[k][0].copy() for k in range(self.filters)]
        yield tuple(order), list(removed)
        for k in plain_changes(self.filters):
            order[k], order[k + 1] = order[k + 1], order[k]
            before = sum(1 << g for g in order[:k])
            removed[k] = self.step(order[k], before)
            removed[k + 1] = self.step(order[k + 1], before | 1 << order[k])
            for f, lost in zip(order, removed, strict=True):
                self.shapley[f] += lost[0]
            yield tuple(order), list(removed)


def report(parts: list[str], n: np.ndarray, good: np.ndarray, toxic: np.ndarray, letters: str = LETTERS) -> pa.RecordBatch:
    """The rows of some parts."""
    filters = len(letters)
    walk = Walk(n, good, toxic, filters)
    failing = [n[:, walk.fails[f]].sum(1) for f in range(filters)]
    total, own = n.sum(1), {c: [] for c in COLUMNS}
    for order, removed in walk.run():
        kept = total
        for k, (f, lost) in enumerate(zip(order, removed, strict=True)):
            kept = kept - lost[0]
            values = (kept, lost[0], failing[f] - lost[0], n[:, 1 << f], lost[1], lost[2], f)
            for c, v in zip(COLUMNS, ("".join(letters[g] for g in order), k + 1, *values), strict=True):
                own[c].append(v)
    steps = math.factorial(filters) * filters
    columns = [pa.array([p for p in parts for _ in range(steps)], pa.string()), pa.array(own["filter_order"] * len(parts), pa.string()), pa.array(np.tile(np.array(own["step"], np.int32), len(parts)))]
    own["shapley"] = [walk.shapley[f] for f in own["shapley"]]
    columns += [pa.array(np.stack(own[c], 1).astype(np.int64).ravel()) for c in COLUMNS[2:]]
    return pa.RecordBatch.from_arrays(columns, ["part", *COLUMNS])


COLUMNS = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step; see the module's text."""
    found = cells(written(judged(docs, id_col, text_col, part_col)), labels)
    # at most 32 cells for each part, whatever its size
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PARTS_AT_ONCE):
                parts = batch.column(0)[i : i + PARTS_AT_ONCE].to_pylist()
                tables = np.zeros((3, len(parts), 1 << len(LETTERS)), np.int64)
                for p, own in enumerate(batch.column(1)[i : i + PARTS_AT_ONCE].to_pylist()):
                    for cell in own:
                        tables[:, p, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                yield report(parts, *tables)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS[2:])
    return by_part.mapInArrow(run, schema)


#: All orders, for tests and SQL.
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
