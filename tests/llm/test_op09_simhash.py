import random
import re

import numpy as np
import pytest
import xxhash

from pagemill.llm.components import components
from pagemill.llm.op09_simhash import forest, links, near_duplicates, spanning


def fingerprint(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(nodes, near):
    """The least node that each reaches."""
    label = {n: n for n in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if near(a, b):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def brute(rows):
    prints = [fingerprint(t, 3) for _, t, *_ in rows]
    label = reach(range(len(rows)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    return out


def test_against_brute_force(odd_docs, odd_rows):
    got = near_duplicates(odd_docs, 3).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == sorted(brute(odd_rows), key=str)


def test_null_and_wide_ids_in_one_task(spark):
    """Null ids beside links, and ids that a float can't hold."""
    text = "the of and river stone cloud of the and in to open close"
    rows = [(None, text), ((1 << 53) + 1, text), ((1 << 53) + 3, text + " x"), (None, None), ((1 << 62) + 7, ""), (None, "alone in the cloud is a word or two")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3).coalesce(1).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize(("distance", "parts"), [(3, 2), (7, 4), (3, 4), (5, 3)])
def test_links_connect_what_is_near(spark, distance, parts):
    """Chains and dense groups of fingerprints."""
    rng = random.Random(distance)
    values = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            values.append(base)
            for _ in range(rng.randint(1, 4)):
                base ^= 1 << rng.randrange(64)
    values = sorted(set(values))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    got = {r["node"]: r["component"] for r in components(links(df, distance, parts)).collect()}
    want = reach(sorted(map(signed, values)), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= distance)
    assert {v: got.get(v, v) for v in want} == want


def test_spanning_links():
    a, b = np.array([5, 7, 9, 1, 20]), np.array([7, 9, 5, 2, 21])
    x, y = spanning(a, b)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(2, 1), (7, 5), (9, 5), (21, 20)]
    found = forest(np.array([0, 1, 3, 255, 254], np.uint64), 1)
    assert len(found) == 3


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and 5000 not in got


def test_null_ids_and_empty_table(odd_docs, odd_rows, no_docs):
    assert near_duplicates(odd_docs).count() == len(odd_rows)
    assert near_duplicates(no_docs).count() == 0
