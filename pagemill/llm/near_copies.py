"""Near copies by exact Jaccard similarity of word shingles.

Two searches only propose: SimHash fingerprints that multi-index hashing finds within three bits
of each other, and MinHash bands, where texts that share a band's ``ROWS`` least hashes form a group.
Within what is proposed the shingle sets themselves are compared. A link stands for a similarity
of at least four fifths, never for an estimate. A pair at exactly 0.8 meets in none of the
``BANDS`` bands with a chance of (1 - 0.8**6)**48, under one in two million for independent hashes; closer pairs more rarely.

Texts with equal sets fold into one node before any search. Groups with the same members fold
into one before sets are sent to them, and groups of one are never sent. A group's nodes are linked
by a spanning forest of true links, so a dense group gives no more links than members.

Cases: texts without words have one (empty) set and are copies of each other; texts shorter than
the shingle are one shingle; a null doc_id links others but is never the least one; rows that repeat a
doc_id are told apart by the hash of their texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_np import flat, slices, spread
from .components import components
from .op09_simhash import links, shingle_hashes, simhash
from .session import cut

ROWS, BANDS = 6, 48
#: An odd factor for each hash function.
FACTORS = np.random.default_rng(42).integers(0, 1 << 32, (BANDS, ROWS), np.uint32) | np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text in order, and how many each has."""
    return _sets(*shingle_hashes(data, off, size))


def _sets(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.repeat(np.arange(len(count)), count)
    h = h[np.lexsort((h, text))]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[first], np.bincount(text[first], minlength=len(count))


def digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number for each set, 0 for the empty one."""
    out = np.zeros(len(n), np.uint64)
    own = np.flatnonzero(n)
    if len(own):
        out[own] = np.add.reduceat(h, (np.cumsum(n) - n)[own])
    return out.view(np.int64)


def band_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each set that is not empty."""
    own = np.flatnonzero(n)
    out = np.zeros((len(own), BANDS), np.uint64)
    if len(own):
        begin = (np.cumsum(n) - n)[own]
        x = (h ^ h >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS):
            key = np.full(len(own), k, np.uint64)
            for a in FACTORS[k]:
                key = (key ^ np.minimum.reduceat(x * a, begin)) * MIX
                key ^= key >> np.uint64(29)
            out[:, k] = key
    return out.view(np.int64)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_sha256, node, fingerprint, keys``: the digest of each row's set, its SimHash and its band keys."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(2))
            for i, j in slices(off):
                every, count = shingle_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                h, n = _sets(every, count)
                edge = np.concatenate([[0], np.cumsum(BANDS * (n > 0))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(edge), pa.array(band_keys(h, n).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(digests(h, n)), pa.array(simhash(every, count).view(np.int64)), keys], ["doc_id", "text_sha256", "node", "fingerprint", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sha(text_col).alias("text_sha256"), text_col)
    return rows.mapInArrow(run, "doc_id long, text_sha256 string, node long, fingerprint long, keys array<long>")


def sha(text_col: str = "text") -> Column:
    """What tells rows of one doc_id apart."""
    return F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)


def near_prints(own: DataFrame, distance: int = 3, parts: int = 2) -> DataFrame:
    """``grp, node`` of the nodes whose fingerprints are equal or linked by multi-index hashing."""
    nodes = own.select("fingerprint", "node").distinct()
    pairs = links(own.select("fingerprint").distinct(), distance, parts)
    linked = pairs.select(F.xxhash64("a", "b").alias("grp"), F.explode(F.array("a", "b")).alias("fingerprint"))
    equal = nodes.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("fingerprint").alias("grp"), "fingerprint")
    return linked.unionByName(equal).join(nodes, "fingerprint").select("grp", "node")


def groups(keys: DataFrame) -> DataFrame:
    """``grp, node`` of the nodes that meet under one of ``keys (key, node)``; equal groups are one."""

    def run(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        key, node = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        mixed = node.view(np.uint64) * MIX
        mixed = (mixed ^ mixed >> np.uint64(31)) * MIX
        name = np.repeat(np.add.reduceat(mixed, start).view(np.int64), size)
        met = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(name[met]), pa.array(node[met])], ["grp", "node"])

    return keys.repartition("key").mapInArrow(run, "grp long, node long").distinct()


def near_links(node: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links (pairs of nodes) of sets with a Jaccard similarity of 0.8 or more: breadth-first, each set visited once."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(node[0]), int(node[1]))] if 9 * both >= 4 * n.sum() else []
    h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(h, kind="stable")
    sorted_h, holder = h[order], own[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    run = np.empty(len(h), np.int64)  # of each element, the place of its hash's holders
    run[order] = np.repeat(np.arange(len(start)), size)
    edge = np.concatenate([[0], np.cumsum(n)])
    left, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue and left.any():
            x = queue.pop()
            r = run[edge[x] : edge[x + 1]]
            both = np.bincount(holder[spread(start[r], size[r])], minlength=len(sets))
            found = np.flatnonzero(left & (9 * both >= 4 * (n[x] + n)))
            left[found] = False
            queue += found.tolist()
            out += [(int(node[x]), int(node[y])) for y in found]
    return out


def verified(docs: DataFrame, own: DataFrame, met: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: true links between the nodes of each group; only these nodes' texts are read again."""

    def content(batches):
        for batch in batches:
            data, off = flat(batch.column(0))
            for i, j in slices(off):
                h, n = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                edge = np.concatenate([[0], np.cumsum(n)])
                kept = [h[edge[k] : edge[k + 1]].tobytes() for k in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(digests(h, n)), pa.array(kept, pa.binary())], ["node", "hashes"])

    def compare(batches):
        now, members = None, {}
        pairs = []
        for batch in batches:
            for grp, node, hashes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if grp != now:
                    if len(members) > 1:
                        pairs += near_links(np.array(list(members)), list(members.values()))
                    now, members = grp, {}
                members[node] = np.frombuffer(hashes, np.uint64)
        if len(members) > 1:
            pairs += near_links(np.array(list(members)), list(members.values()))
        if pairs:
            ab = np.unique(np.sort(np.array(pairs, np.int64), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, c])) for c in (0, 1)], ["a", "b"])

    wanted = own.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("__id")).select("__id").distinct()
    chosen = docs.join(wanted, docs[id_col].cast("long").eqNullSafe(F.col("__id")), "left_semi").select(text_col)
    sets = chosen.mapInArrow(content, "node long, hashes binary")
    return met.join(sets, "node").select("grp", "node", "hashes").repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, component_id, kept`` of every row; a component's id is its least doc_id.

    Of each component the row with the least doc_id is kept, of equal ids that with the least hash; rows
    equal in both share their verdict.
    """
    own = cut(sketches(docs, size, id_col, text_col))
    keys = own.groupBy("node").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node")
    met = cut(groups(keys).unionByName(near_prints(own)).distinct())
    joined = components(verified(docs, own, met, size, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")).alias("least")
    nodes = own.groupBy("node").agg(first).join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("least").alias("least"))
    label = nodes.select("node", "component").join(least, "component").select("node", "least")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_sha256") == F.col("least.text_sha256"))
    return own.select("doc_id", "text_sha256", "node").join(label, "node").select("doc_id", "text_sha256", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
