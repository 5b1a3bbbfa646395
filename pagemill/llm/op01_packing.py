"""Hierarchical multi-length packing of documents into training sequences.

Each partition packs what it reads, without a shuffle. A document's tokens, with the
end id, first give whole windows of the longest tier. The rest is routed to a tier by its
length: the shortest tier that holds it. A rest opens a window of its tier, whose gap is
filled from that tier and the shorter ones, best fit first; when no piece fits, one
is cut to fit. The last tokens of a partition go to windows whose lengths are powers of two, which
need no padding. Waiting pieces are bounded (``pool`` for each tier), so memory is too.

Windows are dealt to step groups of ``step`` windows from a buffer of several steps, in
snake order of their attention cost (the sum of squared piece lengths), so steps cost
about the same.

Ids are those of ``tokenizers`` with its default settings. They come from ``tiktoken`` over the same
merges, which is faster; a string of an added token becomes its id, and a text that
is too much for that library's patterns (a run of some hundred thousand blanks) goes through ``tokenizers``.

Cases: a null or empty text is its end id alone; rows that repeat a doc_id, or have none, are packed
each by itself; an empty table gives no rows; other columns are ignored. A long text is encoded whole:
a task holds its bytes some twenty times.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (1024, 512, 256, 128)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"


class Encoder:
    """The byte-level BPE of ``vocabulary`` (a tokenizers file; its ranks lie beside it with the ending .tiktoken)."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        self.path, self.plain = vocabulary, None
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(vocabulary) as f:
            self.added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _part(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)
        except ValueError:  # its pattern's stack is too small for this text
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.path)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.cut is None or not any(t in text for t in self.added):
            return self._part(text)
        parts = [np.array([self.added[p]], "<u4") if p in self.added else self._part(p) for p in self.cut.split(text) if p]
        return np.concatenate(parts)


class Packer:
    """Packs pieces ``(doc, start, ids, doc_tokens)`` as they come; ``done`` gets finished windows."""

    def __init__(self, tiers=TIERS, pool: int = 2048, step: int = 16, steps: int = 8):
        self.tiers, self.pool, self.step, self.steps = tuple(sorted(tiers, reverse=True)), pool, step, steps
        self.top = self.tiers[0]
        #: For each tier the waiting pieces, by length and order of coming.
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.come = self.sequences = self.groups = 0
        self.buffer: list[tuple[int, list]] = []

    def tier(self, n: int) -> int:
        return min(t for t in self.tiers if t >= n)

    def add(self, doc: int, ids: np.ndarray, first: int = 0) -> Iterator[tuple]:
        n, at = len(ids), 0
        while n - at >= self.top:
            yield from self.close([(doc, first + at, ids[at : at + self.top], n)])
            at += self.top
        if at < n:
            self.wait((doc, first + at, ids[at:], n))
        for t in self.tiers:
            while len(self.waiting[t]) > self.pool:
                yield from self.open(t)

    def wait(self, piece: tuple) -> None:
        insort(self.waiting[self.tier(len(piece[2]))], (len(piece[2]), self.come, piece))
        self.come += 1

    def open(self, t: int) -> Iterator[tuple]:
        """Start a window of tier t with its longest waiting piece and fill the gap."""
        window = [self.waiting[t].pop()[2]]
        gap = t - len(window[0][2])
        while gap:
            found = None
            for s in self.tiers:  # the longest waiting piece that fits
                row = self.waiting[s]
                k = bisect_right(row, gap, key=lambda x: x[0]) - 1
                if k >= 0:
                    found = row.pop(k)[2]
                    break
            if found is None:  # none fits: cut the shortest that waits
                row = next((self.waiting[s] for s in reversed(self.tiers) if self.waiting[s]), None)
                if row is None:
                    yield from self.last(window)
                    return
                doc, start, ids, n = row.pop(0)[2]
                found = (doc, start, ids[:gap], n)
                self.wait((doc, start + gap, ids[gap:], n))
            window.append(found)
            gap -= len(found[2])
        yield from self.close(window)

    def last(self, window: list) -> Iterator[tuple]:
        """Deal an unfilled window out to windows whose lengths are powers of two."""
        total = sum(len(p[2]) for p in window)
        size = 1 << total.bit_length()
        while window:
            size >>= 1
            if not total & size:
                continue
            part, left = [], size
            while left:
                doc, start, ids, n = window.pop(0)
                part.append((doc, start, ids[:left], n))
                if len(ids) > left:
                    window.insert(0, (doc, start + left, ids[left:], n))
                left -= len(part[-1][2])
            yield from self.close(part)

    def close(self, window: list) -> Iterator[tuple]:
        self.buffer.append((sum(len(p[2]) ** 2 for p in window), window))
        if len(self.buffer) == self.step * self.steps:
            yield from self.deal()

    def deal(self) -> Iterator[tuple]:
        """Step groups from the buffer, in snake order of cost."""
        groups = max(1, -(-len(self.buffer) // self.step))
        for i, (_, window) in enumerate(sorted(self.buffer, key=lambda x: -x[0])):
            lap, k = divmod(i, groups)
            yield self.sequences, self.groups + (groups - 1 - k if lap % 2 else k), window
            self.sequences += 1
        self.groups += groups
        self.buffer = []

    def finish(self) -> Iterator[tuple]:
        for t in self.tiers:
            while self.waiting[t]:
                yield from self.open(t)
        yield from self.deal()


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, tiers=TIERS, pool: int = 2048, step: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``ids`` are its token ids as little-endian unsigned 32-bit integers.

    Sequence and step numbers are the partition's number times 2**40, plus a count.
    """

    def run(batches):
        encode, packer = Encoder(vocabulary), Packer(tiers, pool, step)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def take(windows):
            for sequence, group, window in windows:
                at, total = 0, sum(len(p[2]) for p in window)
                for doc, start, ids, n in window:
                    rows.append((doc, start, len(ids), ids.tobytes(), n, base + sequence, at, total, packer.tier(total), base + group))
                    at += len(ids)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)
            rows.clear()
            return batch

        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.concatenate([encode(text), end]) if text else end
                take(packer.add(doc, ids))
                if len(rows) >= 4096:
                    yield flush()
        take(packer.finish())
        if rows:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
