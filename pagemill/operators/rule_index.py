"""Rules found by bit sets: for each value of a field the set of rules that it satisfies, ANDed for a context.

A rule is a bit. A field's set for a value holds the rules that name the value and those that say nothing of the
field; a context's rules are the intersection over its fields. Sets are arrays of 64-bit words, so 10,000 rules are 157 words, and a
batch of contexts is one AND of matrices for each field, whatever the number of rules that don't match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

WORD = 64
#: Contexts whose sets are intersected at once.
ROWS = 1024


def bits(flags: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words."""
    padded = np.zeros(-(-len(flags) // WORD) * WORD, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


class RuleIndex:
    """Bit sets of some rules, rows with an array of values (null: no condition) for each field."""

    def __init__(self, rules: list[Row], fields: tuple[str, ...]):
        self.n, self.fields = len(rules), fields
        self.free, self.sets = {}, {}
        for f in (*fields, "traits_any"):
            conditions = [r[f] for r in rules]
            self.free[f] = bits(np.array([c is None for c in conditions], bool))
            values = {v for c in conditions if c for v in c if v is not None}
            self.sets[f] = {v: bits(np.array([c is None or v in c for c in conditions], bool)) for v in values}
        needs = [r["traits_all"] for r in rules]
        #: rules that need a trait, and those that ask for any (a context without an array of traits meets none of these)
        self.need = {v: bits(np.array([c is not None and v in c for c in needs], bool)) for v in {v for c in needs if c for v in c}}
        self.asks = bits(np.array([c is not None for c in needs], bool))

    def scalar(self, f: str, column: pa.Array) -> np.ndarray:
        """The sets of a column's values, a row each."""
        coded = column.cast(pa.string()).dictionary_encode()
        table = np.stack([*(self.sets[f].get(v, self.free[f]) for v in coded.dictionary.to_pylist()), self.free[f]])
        return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]

    def traits(self, column: pa.Array) -> np.ndarray:
        own = column.to_pylist()
        kinds = {t: k for k, t in enumerate(sorted({t for ts in own if ts for t in ts if t is not None} | set(self.need)))}
        has = np.zeros((len(own), len(kinds)), bool)
        for i, ts in enumerate(own):
            for t in ts or ():
                if t is not None:
                    has[i, kinds[t]] = True
        some = np.repeat(self.free["traits_any"][None], len(own), 0)
        lacks = np.zeros_like(some)
        for t, k in kinds.items():
            if t in self.sets["traits_any"]:
                some[has[:, k]] |= self.sets["traits_any"][t]
            if t in self.need:
                lacks[~has[:, k]] |= self.need[t]
        lacks[np.array([ts is None for ts in own], bool)] |= self.asks
        return some & ~lacks

    def matching(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
        """Parts of a batch with the numbers of the rules that each row meets."""
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            sets = self.traits(part.column("traits"))
            for f in self.fields:
                sets &= self.scalar(f, part.column(f))
            flags = np.unpackbits(np.ascontiguousarray(sets).view(np.uint8), axis=1, bitorder="little", count=self.n)
            row, rule = np.nonzero(flags)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield part, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rule, pa.int32()))
