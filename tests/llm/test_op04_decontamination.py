import re

import numpy as np
import pytest

from pagemill.llm.op04_decontamination import FMIndex, find_contamination
from pagemill.llm.queries import contamination_digest

ITEMS = [(1, "the of and to in stone river cloud"), (2, "Stone, RIVER-cloud!"), (10, "error warn"), (11, "error warn"), (3, None), (4, "  ,;"), (5, "café naïve 42")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text, *_ in rows:
        w, found = words(text), set()
        hit = [False] * len(w)
        for win, owners in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    found |= owners
                    hit[i : i + len(win)] = [True] * len(win)
        out.append((doc, len(w), hit, sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "block"), [(13, 1 << 20), (2, 1 << 20), (1, 1 << 20), (3, 20)])
def test_against_brute_force(spark, odd_docs, odd_rows, window, block):
    """Each row by itself, repeated and null ids too, whatever the number of blocks."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = []
    for r in find_contamination(odd_docs, bench, window, block).collect():
        hit = [False] * r["n_words"]
        for s in r["spans"]:
            hit[s["start"] : s["stop"]] = [True] * (s["stop"] - s["start"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        got.append((r["doc_id"], r["n_words"], hit, r["item_ids"]))
    assert sorted(got, key=str) == brute(odd_rows, ITEMS, window)


def test_rule_of_a_twentieth(spark):
    bench = spark.createDataFrame([(9, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta " + "x " * 38), (2, "alpha beta " + "x " * 39), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in contamination_digest(find_contamination(docs, bench)).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (0, False)}


def test_rows_keep_their_numbers(spark, odd_docs):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd_docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("no"))
    one, more = (sorted(map(str, find_contamination(docs, bench, 2, b, keep_row="no").collect())) for b in (1 << 20, 20))
    assert one == more and len(one) == docs.count()


def test_empty_tables(spark, no_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(no_docs, bench).count() == 0
    assert find_contamination(odd_docs, bench).where("size(item_ids) > 0").count() == 0


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 300)
    text[-1] = 0
    index = FMIndex(text, 3)
    pattern = rng.integers(1, 4, (50, 3))
    lo, hi = index.search(pattern.ravel(), np.arange(0, 150, 3), 3)
    for p, a, b in zip(pattern, lo, hi, strict=True):
        at = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == at
