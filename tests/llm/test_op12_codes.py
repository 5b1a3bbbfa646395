import math
import random

import numpy as np
import pytest

from pagemill.llm.op12_codes import Codebook, by_label, compress

SCHEMA = "vec_id long, embedding array<float>, label int, q int, code string, error int, same_label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(vec_id, position): ...} by plain loops: rows with code, error and label error, and the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1])
    own = [r for r in kept if len(r[1]) == w]
    s = w // parts
    cut = lambda v, p: v[p * s : (p + 1) * s]
    books = [[cut(r[1], p) for r in own[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in own:
                groups.setdefault(near(cut(r[1], p), books[p])[1], []).append(cut(r[1], p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    out, sums = [], {}
    for r in own:
        best = [near(cut(r[1], p), books[p]) for p in range(parts)]
        out.append([r[0], r[2], bytes(e for _, e in best), sum(d for d, _ in best)])
        sums[r[2]] = sums.get(r[2], 0) + out[-1][3]
    done = [(*o, sums[o[1]]) for o in out] + [(r[0], r[2], None, None, None) for r in kept if len(r[1]) != w]
    return done, books


def key(r):
    return tuple((x is None, x) for x in r)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    coded, books = compress(df)
    got = [(r["vec_id"], r["label"], None if r["code"] is None else bytes(r["code"]), r["error"], r["label_error"]) for r in by_label(coded).collect()]
    want, want_books = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert books.tolist() == want_books if want else books.size == 0


def vectors(rng, n, width=16, spread=1.0):
    return [(i, [rng.choice([0.0, rng.gauss(0, spread)]) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


def test_random_vectors(spark):
    check(spark, vectors(random.Random(1), 150))


def test_ties_copies_and_zero_vectors(spark):
    rng = random.Random(2)
    base = [(i, [float(rng.randint(-1, 1)) for _ in range(8)], i % 2) for i in range(60)]
    check(spark, base + [(100 + i, [0.0] * 8, None) for i in range(20)] + [base[0], base[0]])


def test_odd_rows(spark):
    rows = vectors(random.Random(3), 30)
    nan, inf = float("nan"), float("inf")
    rows += [(40, None, 1), (41, [nan] + [0.0] * 15, 1), (42, [inf] + [0.0] * 15, 1), (43, [None] + [0.0] * 15, 1), (None, [1.0] * 16, 1), (None, [0.5] * 16, None), (44, [1.0] * 8, 2), (45, [], 2), (3, [9.0] * 16, 1), (50, [16000.0, -16000.0] * 8, 5)]
    check(spark, rows)


def test_fewer_vectors_than_entries(spark):
    check(spark, vectors(random.Random(4), 5))


def test_empty_and_all_dropped(spark):
    check(spark, [])
    check(spark, [(1, None, 1), (2, [None], 2)])
    check(spark, [(1, [], 1), (2, [], None)])


@pytest.mark.parametrize(("row", "said"), [((1, [1.0] * 12, 1), "equal parts"), ((1, [1e9] * 16, 1), "exact"), ((1, [-1e30] * 16, 1), "exact")])
def test_refused(spark, row, said):
    with pytest.raises(ValueError, match=said):
        compress(spark.createDataFrame([(*row, 1, "x", 2, 3)], SCHEMA))


def test_annulus_leaves_entries_out_and_keeps_ties():
    rng = np.random.default_rng(5)
    entries = rng.integers(-3, 4, (16, 4)) * np.arange(1, 17)[:, None] * 500  # norms far apart
    x = np.concatenate([entries[rng.integers(0, 16, 400)] + rng.integers(-40, 41, (400, 4)), np.zeros((2, 4), int), entries])
    index, least, compared = Codebook(entries).nearest(x)
    far = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (least == far.min(1)).all() and (index == far.argmin(1)).all()
    assert compared < 0.5 * far.size
