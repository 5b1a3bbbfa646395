"""Substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that a string of ``length`` bytes covers which also starts in a document with a smaller
doc_id is removed. One suffix array over everything can't be had at scale, so strings are
brought together by content:

1. Each window of ``length`` bytes has an anchor, its least-hashed ``k``-byte part. Equal windows
   have equal anchors. Windows of a text that share an anchor are one piece, a string of
   at most ``2 * length - k`` bytes. Tasks send anchors' hashes (32 bits within a shard) with their
   texts; anchors that two texts have are suspects.
2. Texts with suspects send the suspects' pieces to the anchors' shards. Equal pieces fold
   into one, with the least document they stand in.
3. A shard takes its anchors' pieces some megabytes at a time and sorts their suffixes. On
   the Burrows-Wheeler transform, intervals are extended backward breadth-first, which gives the
   common prefixes of neighbours by increasing value, and stops at ``length``. Neighbours that have
   no value by then share a whole window. The least document of such a set decides.
4. Removed ranges go back to their texts and are merged.

A very common anchor's pieces are folded by each task and again in the shard. Where its different strings
are more than fits a batch, they are cut to the windows that may be shared before they are sorted.

Cases: a null text counts as empty; a text of any length is read in parts of half a megabyte, and a part's end may
cut a piece in two, never a window; texts shorter than ``length`` lose nothing; rows that repeat a
doc_id are judged each by itself against smaller ids; a null doc_id counts as larger than
all others; an empty table gives an empty result; other columns are ignored. Removed bytes may cut
a character, so kept bytes are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import MIX1, U64, BYTE_VALUE, flat, mix, pack_bytes, rolling_hash, runs, slices, sliding_min, spans_hash, spread, squeeze, squeeze_codes, unpack_bytes, unsqueeze, unsqueeze_codes
from .session import shuffle_width

LENGTH, K = 50, 24
SLICE, PART = 8 << 20, 1 << 19
BATCH_BYTES = 1 << 19
LAST = (1 << 63) - 1  # stands for a null doc_id


def pieces(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, start, length and the string's hash of each piece of a slice's texts."""
    parts = []
    for i, j in slices(off, PART):  # arrays of eight bytes for each byte stay small
        # a longer text goes window by window too: its parts overlap by a window less one byte
        for lo in range(int(off[i]), max(int(off[i]) + 1, int(off[j]) - length + 1), PART) if j == i + 1 else (int(off[i]),):
            hi = min(int(off[j]), lo + PART + length - 1) if j == i + 1 else int(off[j])
            own = np.array([0, hi - lo], np.int64) if j == i + 1 else off[i : j + 1] - lo
            h, text, start, size, g = _pieces(data[lo:hi], own, length, k)
            parts.append((h, text + i, start + lo, size, g))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _pieces(data, off, length, k)


def _pieces(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    none = (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, U64))
    size = np.diff(off)
    count = np.maximum(size - length + 1, 0)
    if not count.sum():
        return none
    h = rolling_hash(data, k)
    least = sliding_min((h & ~U64(0xFFFFFFFF)) | np.arange(n, dtype=U64), length - k + 1)
    window = spread(off[:-1], count)
    anchor = (least[window] & U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(size)), count)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(first, len(anchor)))
    # a window's least hashes are small ones: mixed again, they spread over the shards
    text, start, size = text[first], window[first], windows + length - 1
    return mix(h[anchor[first]]), text, start, size, string_hash(rolling_hash(data, length), start, size, length)


def string_hash(window: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Hash of strings of less than two windows' length by the hashes of their first and last window."""
    return mix(window[start] + MIX1 * window[start + size - length] + size.astype(U64))


class Shards:
    """Equal ranges of the 64-bit hashes; a code is the shard's number and 32 bits of the hash within it."""

    def __init__(self, n: int):
        self.n, width = n, (1 << 64) // n + 1
        self.edge = np.array([width * s for s in range(n)], U64)
        self.shift = U64(max(0, (width - 1).bit_length() - 32))

    def of(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, h, side="right") - 1

    def code(self, h: np.ndarray) -> np.ndarray:
        s = self.of(h)
        return s.astype(U64) << U64(32) | (h - self.edge[s]) >> self.shift


def _by_shard(shard: np.ndarray, n: int):
    """The order that brings shards together, and (shard, slice of the order) of those that have any."""
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(n + 1))
    return order, [(s, slice(edge[s], edge[s + 1])) for s in np.flatnonzero(np.diff(edge)).tolist()]


ANCHORS = "shard int, key long, texts binary, codes binary, text binary"


def _record(rows: list, types: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])


def anchor_blobs(rows: DataFrame, n: int, length: int, k: int) -> DataFrame:
    """A slice's anchors for each shard (texts, codes, text numbers), and rows of a text's anchors that are suspects already.

    A shard gets the keys of the texts that it has anchors of, so rows don't grow with the number of shards.
    """
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def run(batches):
        shards = Shards(n)
        for batch in batches:
            data, off = flat(batch.column(0))
            key = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(off, SLICE):
                h, text, _, _, _ = pieces(data[off[i] : off[j]], off[i : j + 1] - off[i], length, k)
                if not len(h):
                    continue
                own = key[i:j]
                code = shards.code(h)
                order = np.lexsort((own[text], code))
                code, text = code[order], text[order]
                new = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])
                code, text = code[new], text[new]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                size = np.diff(np.append(first, len(code)))
                last = first + size - 1
                shared = own[text[first]] < own[text[last]]  # two texts of this slice have it
                many = np.repeat(shared, size)
                out = []
                if many.any():
                    t, c = text[many], code[many]
                    order = np.argsort(t, kind="stable")
                    t, c = t[order], c[order]
                    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                    for a, b in zip(at, np.append(at[1:], len(t))):
                        out.append((int(t[a]) % n, int(own[t[a]]), None, squeeze_codes(c[a:b]), None))
                send = np.sort(np.concatenate([first, last[shared]]))
                if not shared.all():  # rows that repeat one key: each needs the answer
                    send = np.union1d(send, np.flatnonzero(~many))
                code, text = code[send], text[send]
                _, parts = _by_shard((code >> U64(32)).astype(np.int64), n)
                for s, at in parts:
                    used, which = np.unique(text[at], return_inverse=True)
                    out.append((s, 0, own[used].astype("<i8").tobytes(), squeeze(code[at] & U64(0xFFFFFFFF), ascending=True), squeeze(which)))
                yield _record(out, types, ANCHORS)

    return rows.select("text", "key").mapInArrow(run, ANCHORS)


def _group(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The group of each text, of n: results of a shard go to groups in one row each, not to each text by itself."""
    return (mix(doc.astype(U64) * MIX1 + key.view(U64)) % U64(n)).astype(np.int64)


def _by_text(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in sorted rows, and how many rows it has."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    return at, np.diff(np.append(at, len(doc)))


FOUND = "part int, shard int, texts binary, counts binary, a binary, b binary"
FOUND_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 4]


def _found(doc: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, shard: int, n: int) -> list[tuple]:
    """Rows for each group of texts that has any: the texts, how many values each has, and the values."""
    group = _group(doc, key, n)
    order = np.lexsort((a, key, doc, group))
    doc, key, a, b, group = doc[order], key[order], a[order], b[order], group[order]
    edge, out = np.searchsorted(group, np.arange(n + 1)), []
    for g in np.flatnonzero(np.diff(edge)).tolist():
        s = slice(edge[g], edge[g + 1])
        at, count = _by_text(doc[s], key[s])
        out.append((g, shard, pack_bytes(np.stack([doc[s][at], key[s][at]]).astype("<i8").tobytes()), squeeze(count), squeeze(a[s]), squeeze(b[s])))
    return out


def _texts(blobs: DataFrame, n: int, schema: str, merge) -> DataFrame:
    """What all shards found, as one row for each text: ``merge(shard, a, b)`` gives its bytes."""

    def run(batches):
        kept = []
        for batch in batches:
            for _, shard, texts, counts, a, b in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                doc, key = np.frombuffer(unpack_bytes(texts), "<i8").reshape(2, -1)
                count = unsqueeze(counts).astype(np.int64)
                kept.append((np.repeat(doc, count), np.repeat(key, count), np.full(int(count.sum()), shard), unsqueeze(a), unsqueeze(b)))
        if not kept:
            return
        doc, key, shard, a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
        del kept
        order = np.lexsort((key, doc))
        doc, key, shard, a, b = doc[order], key[order], shard[order], a[order], b[order]
        at, count = _by_text(doc, key)
        for i in range(0, len(at), 2048):
            yield _record([(int(doc[p]), int(key[p]), merge(shard[p : p + c], a[p : p + c], b[p : p + c])) for p, c in zip(at[i : i + 2048].tolist(), count[i : i + 2048].tolist(), strict=True)], [pa.int64(), pa.int64(), pa.binary()], schema)

    return blobs.repartitionById(n, "part").mapInArrow(run, schema)


def suspects(blobs: DataFrame, n: int) -> DataFrame:
    """``key, codes``: codes of each text's anchors that two texts have."""

    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            ready = []
            for s, key, table, codes, text in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if table is None:
                    code = unsqueeze_codes(codes)
                    one = np.zeros(1, np.int64), np.array([key], np.int64)
                    ready.append((int(_group(*one, n)[0]), 0, pack_bytes(np.stack(one).astype("<i8").tobytes()), squeeze(np.array([len(code)])), squeeze(code & U64(0xFFFFFFFF)), squeeze(code >> U64(32))))
                else:
                    kept.setdefault(s, []).append((unsqueeze(codes, ascending=True), np.frombuffer(table, "<i8")[unsqueeze(text)]))
            if ready:
                yield _record(ready, FOUND_TYPES, FOUND)
        for s, parts in kept.items():
            code, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(code)
            code, key = code[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            size = np.diff(np.append(first, len(code)))
            many = np.repeat(np.minimum.reduceat(key, first) < np.maximum.reduceat(key, first), size)
            if many.any():
                none = np.zeros(int(many.sum()), np.int64)
                yield _record(_found(none, key[many], code[many], none + s, s, n), FOUND_TYPES, FOUND)

    found = blobs.repartitionById(n, "shard").mapInArrow(run, FOUND)
    return _texts(found, n, "doc long, key long, codes binary", lambda s, a, b: squeeze_codes(b.astype(U64) << U64(32) | a)).drop("doc")


PIECES = "shard int, texts binary, code binary, size binary, bytes binary, which binary, text binary, start binary"


def piece_blobs(rows: DataFrame, n: int, length: int, k: int) -> DataFrame:
    """Pieces at suspect anchors of ``rows (text, doc, key, codes)`` for each shard; equal strings of a slice once."""
    types = [pa.int32(), *[pa.binary()] * 7]

    def run(batches):
        shards = Shards(n)
        for batch in batches:
            data, off = flat(batch.column(0))
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            packed = batch.column(3)
            for i, j in slices(off, SLICE):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                h, text, start, size, g = pieces(part, o, length, k)
                if not len(h):
                    continue
                lists = [unsqueeze_codes(x) for x in packed.slice(i, j - i).to_pylist()]
                own = np.concatenate(lists)
                owner = np.repeat(np.arange(j - i), [len(x) for x in lists]).astype(U64)
                asked = np.sort(mix(own + (owner + U64(1)) * MIX1))
                mine = mix(shards.code(h) + (text.astype(U64) + U64(1)) * MIX1)
                at = np.minimum(np.searchsorted(asked, mine), max(0, len(asked) - 1))
                hit = asked[at] == mine if len(asked) else np.zeros(len(mine), bool)
                h, text, start, size, g = h[hit], text[hit], start[hit], size[hit], g[hit]
                if not len(h):
                    continue
                _, one, which = np.unique(h ^ (g * MIX1), return_index=True, return_inverse=True)
                code = shards.code(h[one])
                order = np.argsort(code, kind="stable")
                edge = np.searchsorted(code[order] >> U64(32), np.arange(n + 1, dtype=U64))
                parts = [(s, slice(edge[s], edge[s + 1])) for s in np.flatnonzero(np.diff(edge)).tolist()]
                place = np.empty(len(one), np.int64)
                place[order] = np.arange(len(one))
                occ = np.argsort(place[which], kind="stable")
                occ_place = place[which][occ]
                base = o[text]
                out = []
                for s, at in parts:
                    u = one[order[at]]
                    q = slice(*np.searchsorted(occ_place, [at.start, at.stop]))
                    who = occ[q]
                    begin = start[who] - base[who]
                    used, owner = np.unique(text[who], return_inverse=True)
                    table = np.stack([doc[i + used], key[i + used]]).astype("<i8").tobytes()
                    out.append((s, table, squeeze(code[order[at]] & U64(0xFFFFFFFF), ascending=True), squeeze(size[u]), pack_bytes(part[spread(start[u], size[u])].tobytes()), squeeze(occ_place[q] - at.start, ascending=True), squeeze(owner), squeeze(begin)))
                yield _record(out, types, PIECES)

    return rows.select("text", "doc", "key", "codes").mapInArrow(run, PIECES)


def suffix_array(symbol: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text whose separators (0) are distinct symbols in order of place."""
    n = len(symbol)
    sep = symbol == 0
    to_sep = np.zeros(n, np.int64)  # how far the next separator is
    places = np.flatnonzero(sep)
    to_sep = places[np.searchsorted(places, np.arange(n))] - np.arange(n)
    rank = np.zeros(n, np.int64)
    padded = np.concatenate([symbol, np.zeros(8, symbol.dtype)]).astype(np.int64)
    live = np.ones(n, bool)
    for c in range(6):  # six symbols of nine bits
        rank = rank << 9 | np.where(live, padded[c : c + n], 0)
        live &= padded[c : c + n] != 0
    width, longest = 6, int(to_sep.max())
    while True:
        order = np.argsort(rank)
        r = rank[order]
        dense = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if width > longest:
            break
        later = np.zeros(n, np.int64)
        far = np.flatnonzero(to_sep >= width)
        later[far] = rank[far + width] + 1
        rank = rank * (n + 1) + later
        width *= 2
    return np.argsort(rank * n + np.arange(n))


def shared_prefixes(symbol: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """For each suffix in order, whether it shares ``stop`` symbols or more with the one before it.

    Backward extension of intervals, breadth-first: the extension of a string of v
    symbols ends at a place whose common prefix with the place before is v, if it has no value yet.
    """
    n = len(symbol)
    bwt = symbol[order - 1]  # before the first suffix stands the last separator
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    seps = int(np.count_nonzero(symbol == 0))
    known = np.zeros(n + 1, bool)
    known[n] = True
    known[0] = True
    mark = np.full(n, -1, np.int64)
    lo, hi = np.array([0]), np.array([n - 1])
    for value in range(stop):
        size = hi - lo + 1
        row = spread(lo, size)
        whose = np.repeat(np.arange(len(lo)), size)
        inner = bwt[row] != 0
        row, whose = row[inner], whose[inner]
        to, c = step[row], bwt[row]
        if len(to) * 8 > n:  # sort by marking places
            mark[to] = whose
            place = np.flatnonzero(mark >= 0)
            whose = mark[place]
            mark[place] = -1
            c = symbol[order[place]]
            to = place
        else:
            s = np.argsort(to)
            to, whose, c = to[s], whose[s], c[s]
        if len(to):
            edge = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (whose[1:] != whose[:-1]) | (c[1:] != c[:-1])])
            at = np.flatnonzero(edge)
            lo, hi = to[at], to[np.append(at[1:], len(to)) - 1]
            fresh = ~known[hi + 1]
            lo, hi = lo[fresh], hi[fresh]
            known[hi + 1] = True
        else:
            lo = hi = np.zeros(0, np.int64)
        if value == 0:  # each separator is a symbol too
            known[1 : seps + 1] = True
            lo, hi = np.concatenate([np.arange(seps), lo]), np.concatenate([np.arange(seps), hi])
        if not len(lo):
            break
    return ~known[:n]


def least_owner(strings: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of strings (concatenated): the flat window numbers' least owner among equal windows, and where each string's begin."""
    total = len(strings) + len(size)
    symbol = np.zeros(total, np.int16)
    begin = np.cumsum(size + 1) - (size + 1)
    symbol[spread(begin, size)] = strings.astype(np.int16) + 1
    order = suffix_array(symbol)
    group = np.cumsum(~shared_prefixes(symbol, order, length)) - 1
    whose = np.repeat(np.arange(len(size)), size + 1)[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.empty(total, np.int64)
    least[order] = np.minimum.reduceat(owner[whose], first)[group]
    return least, begin


def trimmed(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of many strings, those that have a window whose hash another window has too: which, from where, how long, and their hash.

    Windows of a hash that occurs once are shared by none, so what lies before a string's first other one, or after its last, is cut.
    """
    flat_raw = raw[spread(begin, size)]
    base = np.cumsum(size) - size
    window = rolling_hash(flat_raw, length)
    count = size - length + 1
    h = window[spread(base, count)]
    order = np.argsort(h)
    h = h[order]
    alike = np.zeros(len(h), bool)
    if len(h) > 1:
        same = h[1:] == h[:-1]
        alike[order[1:]] |= same
        alike[order[:-1]] |= same
    edge = np.cumsum(count) - count
    place = spread(np.zeros(len(count), np.int64), count)
    first = np.minimum.reduceat(np.where(alike, place, 1 << 40), edge)
    last = np.maximum.reduceat(np.where(alike, place, -1), edge)
    own = np.flatnonzero(last >= 0)
    first, left = first[own], (last - first)[own] + length
    return own, first, left, string_hash(window, base[own] + first, left, length)


def removed_spans(blobs: DataFrame, n: int, length: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc, key, spans``: ranges (pairs of 64-bit integers) to remove from each text."""

    def run(batches):
        kept = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                size, raw = unsqueeze(row[3]).astype(np.int64), np.frombuffer(unpack_bytes(row[4]), np.uint8)
                end = np.cumsum(size)
                code = unsqueeze(row[2], ascending=True).astype(U64) | U64(row[0] << 32)
                kept.append((np.frombuffer(row[1], "<i8").reshape(2, -1), code, size, raw, unsqueeze(row[5], ascending=True).astype(np.int64), unsqueeze(row[6]), unsqueeze(row[7]).astype(np.int64), spans_hash(BYTE_VALUE[raw], end - size, end)))
        if not kept:
            return
        shift = np.cumsum([0, *(len(x[1]) for x in kept)])
        doc, key = np.concatenate([x[0][:, x[5]] for x in kept], axis=1)
        anchor, size, raw, start, g = (np.concatenate([x[c] for x in kept]) for c in (1, 2, 3, 6, 7))
        which = np.concatenate([x[4] + s for x, s in zip(kept, shift)])
        del kept
        begin = np.cumsum(size) - size
        # equal strings of an anchor fold into one; strings are in order of their anchors
        order = np.lexsort((g, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (g[order][1:] != g[order][:-1])])
        string = np.empty(len(anchor), np.int64)
        string[order] = np.cumsum(new) - 1
        one = order[new]
        which = string[which]
        by = np.argsort(which, kind="stable")
        least = np.minimum.reduceat(doc[by], np.searchsorted(which[by], np.arange(len(one))))
        anchor, size, begin = anchor[one], size[one], begin[one]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        kinds = np.diff(np.append(first, len(anchor)))
        mixed = (kinds > 1) & (np.minimum.reduceat(least, first) < np.maximum.reduceat(least, first))
        # strings that differ are compared window by window, some anchors at a time
        todo = np.flatnonzero(np.repeat(mixed, kinds))
        run_of, run_lo, run_hi = [], [], []
        if len(todo):
            group = np.repeat(np.arange(len(first)), kinds)[todo]
            fill = np.cumsum(size[todo] + 1)
            at = 0
            while at < len(todo):
                to = int(np.searchsorted(fill, (fill[at - 1] if at else 0) + batch_bytes))
                to = min(len(todo), max(at + 1, to))
                to = int(np.searchsorted(group, group[to - 1], side="right"))  # whole anchors
                part = todo[at:to]
                shift, left, same = np.zeros(len(part), np.int64), size[part], np.arange(len(part))
                if left.sum() > 2 * batch_bytes:  # one very common anchor: only what its strings share matters
                    own, shift, left, g = trimmed(raw, begin[part], left, length)
                    part = part[own]
                    _, kind, same = np.unique(g, return_index=True, return_inverse=True)
                else:
                    kind = same
                if len(part):
                    owner = np.full(len(kind), LAST)
                    np.minimum.at(owner, same, least[part])
                    low, base = least_owner(raw[spread(begin[part][kind] + shift[kind], left[kind])], left[kind], owner, length)
                    windows = left - length + 1
                    hit = low[spread(base[same], windows)] < np.repeat(least[part], windows)
                    edge = np.cumsum(windows) - windows
                    owner = np.repeat(np.arange(len(part)), windows)
                    lo, hi = runs(hit)
                    inner = edge[(edge > 0)]
                    inner = inner[hit[inner] & hit[inner - 1]]
                    lo, hi = np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))
                    run_of.append(part[owner[lo]])
                    run_lo.append(lo - edge[owner[lo]] + shift[owner[lo]])
                    run_hi.append(hi - edge[owner[lo]] + shift[owner[lo]] + length - 1)
                at = to
        late = doc > least[which]  # the whole string stands in an earlier document
        spans = [(doc[late], key[late], start[late], start[late] + size[which[late]])]
        if run_of and sum(map(len, run_of)):
            run_of, run_lo, run_hi = (np.concatenate(x) for x in (run_of, run_lo, run_hi))
            edge = np.searchsorted(run_of, np.arange(len(one) + 1))
            early = np.flatnonzero(~late)
            times = np.diff(edge)[which[early]]
            r, e = spread(edge[:-1][which[early]], times), np.repeat(early, times)
            spans.append((doc[e], key[e], start[e] + run_lo[r], start[e] + run_hi[r]))
        doc, key, lo, hi = (np.concatenate(x) for x in zip(*spans))
        if len(doc):
            yield _record(_found(doc, key, lo, hi - lo, 0, n), FOUND_TYPES, FOUND)

    found = blobs.repartitionById(n, "shard").mapInArrow(run, FOUND)

    def merge(_, start, size):
        start = start.astype(np.int64)
        return np.stack([start, start + size], 1).astype("<i8").tobytes()

    return _texts(found, n, "doc long, key long, spans binary", merge)


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: maximal removed ranges and the bytes that are left, for each input row."""
    n = shuffle_width(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(doc.alias("doc"), F.xxhash64(doc, text).alias("key"), F.encode(text, "UTF-8").alias("text"))
    # two rows of one key would only ask for each other's anchors; spans are told apart by doc too
    asked = suspects(anchor_blobs(rows, n, length, k), n)
    spans = removed_spans(piece_blobs(rows.join(asked, "key"), n, length, k), n, length, batch_bytes).withColumnRenamed("doc", "own")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            data, off = flat(batch.column(1))
            lists = batch.column(2).to_pylist()
            out_spans, out_kept = [], []
            for i, blob in enumerate(lists):
                own = data[off[i] : off[i + 1]]
                if not blob:
                    out_spans.append([])
                    out_kept.append(own.tobytes())
                    continue
                edge = np.zeros(len(own) + 1, np.int64)
                pair = np.frombuffer(blob, "<i8").reshape(-1, 2)
                np.add.at(edge, pair[:, 0], 1)
                np.add.at(edge, pair[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                a, b = runs(gone)
                out_spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist())])
                out_kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(out_spans, kind), pa.array(out_kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    # equality of the documents is written as no join key, so that the texts' exchange is the one above
    same = (rows["key"] == spans["key"]) & (rows["doc"].bitwiseXOR(spans["own"]) == 0)
    whole = rows.join(spans, same, "left").select(F.nullif("doc", F.lit(LAST)).alias("doc"), "text", "spans")
    return whole.mapInArrow(run, KEPT)
