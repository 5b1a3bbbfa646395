"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit where over half of a text's shingle hashes have it. Equal
fingerprints fold into one (their least doc_id stands for them) before any search. A
fingerprint is cut into segments; two fingerprints at distance at most ``d`` differ in
some segment by at most ``r = d // segments``. Each one is put in a table under each of its
segments, and looks up the upper half of the Hamming ball of radius r (0 or 1) around each
segment: of two values that differ in one bit, the one with the zero looks up the other.
What meets under a key is compared in full. A key's fingerprints are linked by a spanning
forest of true links, not by all pairs, so a dense group gives no more links than
members. Components are computed from the links; their nodes are the fingerprints.

Cases: a null or empty text has fingerprint zero and is linked like any other; texts
shorter than the shingle are one shingle; rows that repeat a doc_id are allowed (their
component is the least over their fingerprints); a row with a null doc_id links others, and
its component is the least doc_id that there is, or null; an empty table gives an empty result.
A text of any length is hashed whole; one task holds about 40 times its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import INK, LOWER, Words, flat, popcount, slices, spread, xxh64
from .components import components
from .session import cut

SEED = 42
#: For each byte value, its bits as eight counters in the bytes of an integer.
LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of each text, and how many each has."""
    words = Words(data, off, INK, hashed=False)
    n_bytes = words.stop - words.start
    # the words again with one space after each
    keep = INK[data]
    out = np.full(int(n_bytes.sum()) + len(n_bytes), 32, np.uint8)
    at = np.cumsum(n_bytes + 1) - (n_bytes + 1)
    place = np.ones(len(out), bool)
    place[at + n_bytes] = False
    out[place] = LOWER[data[keep]]
    count = np.where(words.count >= size, words.count - size + 1, np.minimum(words.count, 1))
    begin = np.repeat(words.first[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(begin + size, np.repeat(words.first[1:], count)) - 1
    return xxh64(out, at[begin], at[last] + n_bytes[last] - at[begin], seed), count


def simhash(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from their shingle hashes."""
    ones = np.zeros((len(count), 64), np.int64)
    if len(h):
        # runs of at most 255 shingles of one text, so that counters of a byte do not overflow
        pieces = -(-count // 255)
        first = np.cumsum(count) - count
        begin = np.repeat(first, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        text = np.repeat(np.arange(len(count)), pieces)
        own = np.flatnonzero(pieces)
        edge = (np.cumsum(pieces) - pieces)[own]
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            lanes = np.add.reduceat(LANES[octets[:, b]], begin)
            ones[own, 8 * b : 8 * b + 8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), edge, axis=0)
        del text
    bits = 2 * ones > count[:, None]
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint``: 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            own = [np.zeros(0, np.uint64)]
            for i, j in slices(off):
                own.append(simhash(*shingle_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(own).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, fingerprint long")


def segments(parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    edges = [64 * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def forest(first: np.ndarray, distance: int) -> np.ndarray:
    """Spanning links (index pairs) of near values: breadth-first, each value visited once."""
    left, out = np.arange(len(first)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = popcount(first[left] ^ first[x]) <= distance
            out += [(x, int(y)) for y in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return np.array(out, np.int64).reshape(-1, 2)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links (a, b) connect: each place with the least one it reaches."""
    places, flat_ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat_ab[: len(a)], flat_ab[len(a) :]
    label = np.arange(len(places))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(places)))
    return places[far], places[label[far]]


PAIRS = 1 << 21  # pairs compared at once


def links(prints: DataFrame, distance: int, parts: int) -> DataFrame:
    """``a, b``: links that connect the near ones among the different ``fingerprint``s of ``prints``; a is larger as a signed number."""
    radius = distance // parts
    if radius > 1:
        raise ValueError("more segments are needed: the ball's radius is over 1")
    table = segments(parts)

    def probe(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (shift, bits) in enumerate(table):
                own = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                for flip in [0, *[1 << b for b in range(bits * radius)]]:
                    asks = np.flatnonzero(own & np.uint64(flip) == 0)
                    key = (own[asks] | np.uint64(flip)).astype(np.int64) * parts + k
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[asks].view(np.int64))], ["key", "fingerprint"])

    def verify(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        key, fp = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order].view(np.uint64)
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        k, value = key % parts, key // parts
        shift = np.array([s for s, _ in table], np.uint64)[k]
        mask = np.array([(1 << b) - 1 for _, b in table], np.uint64)[k]
        home = ((fp >> shift) & mask).astype(np.int64) == value
        homes = np.add.reduceat(home.astype(np.int64), start)
        group = np.repeat(np.arange(len(start)), size)
        large = homes * size > PAIRS
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # members of the table against all that look them up
        own = np.flatnonzero(home & ~large[group] & (size > 1)[group])
        work = np.cumsum(size[group[own]])
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS)))
            one = own[at:to]
            other = spread(start[group[one]], size[group[one]])
            one = np.repeat(one, size[group[one]])
            near = one != other
            near &= popcount(fp[one] ^ fp[other]) <= distance
            x, y = spanning(one[near], other[near])
            a.append(x)
            b.append(y)
            at = to
        for g in np.flatnonzero(large & (homes > 0)):
            s = slice(start[g], start[g] + size[g])
            found = forest(fp[s], distance) + start[g]
            a.append(found[:, 0])
            b.append(found[:, 1])
        a, b = (fp[np.concatenate(x)].view(np.int64) for x in (a, b))
        if len(a):
            pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, c])) for c in (0, 1)], ["a", "b"])

    probes = prints.select("fingerprint").mapInArrow(probe, "key long, fingerprint long")
    return probes.repartition("key").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, distance: int = 3, parts: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` of every row of ``docs``."""
    own = cut(fingerprints(docs, size, id_col, text_col))
    nodes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    joined = components(links(nodes, distance, parts))
    group = nodes.join(joined, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    label = group.join(ids, "component").select("fingerprint", "component_id")
    out = own.join(label, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
