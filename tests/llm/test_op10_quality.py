import math
import random
from collections import Counter, defaultdict

import pytest

from pagemill.llm.op10_quality import ORDER, Model, discounts, perplexities, quality


def brute(text: bytes, counts: Counter):
    """Interpolated modified Kneser-Ney by its definition: log10 of each byte's probability."""
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    d = {n: [0, *discounts([list(c.values()).count(k) for k in (1, 2, 3, 4)])] for n, c in orders.items()}
    by = {n: defaultdict(list) for n in orders}
    for n, c in orders.items():
        for g, k in c.items():
            by[n][g[:-1]].append(k)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        group = by[n].get(gram[:-1])
        if not group:
            return p(gram[1:])
        k = orders[n].get(gram, 0)
        left = sum(d[n][min(x, 3)] for x in group)
        return (k - d[n][min(k, 3)] + left * p(gram[1:])) / sum(group)

    return [math.log10(p(g)) for g in each(text)]


def each(text: bytes):
    padded = b"\n" * (ORDER - 1) + text
    return [padded[i : i + ORDER] for i in range(len(text))]


def brute_quality(rows, good, quantile=0.99, slack=1.05, weight=200):
    raw = [(d, lang, (t or "").encode()) for d, t, lang, *_ in rows]
    counts = Counter(g for d, _, t in raw if d in good for g in each(t))
    seen = [(d, lang, brute(t, counts)) for d, lang, t in raw]
    total = sum(counts.values())
    logs = {g: x for t in (t for d, _, t in raw if d in good) for g, x in zip(each(t), brute(t, counts))}
    typical = sum(n * logs[g] for g, n in counts.items()) / total if total else -math.log10(256)
    ppl = [(d, lang, 10 ** (-(sum(x) + weight * typical) / (len(x) + weight)), len(x)) for d, lang, x in seen]

    def limit(values):
        values = sorted(values)
        if not values:
            return math.inf
        at = next(i for i in range(len(values)) if i + 1 >= quantile * len(values))
        return slack * 10 ** ((math.floor(math.log10(values[at]) * 1000) + 1) / 1000)

    every = limit([p for d, _, p, _ in ppl if d in good])
    out = []
    for d, lang, p, n in ppl:
        own = [q for e, other, q, _ in ppl if e in good and other == lang]
        out.append((d, lang, n, p, limit(own) if own else every))
    return out


def pair_up(got, want):
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9) and g[4] == pytest.approx(w[4], rel=1e-9), (g, w)


def test_the_whole_query_against_the_definition(spark, odd_docs, odd_rows):
    """Perplexities and thresholds of all rows; trusted, other, null and repeated ones."""
    good = {1, 4, 7, 31, 34, 40}
    labels = spark.createDataFrame([(d, 1) for d in good] + [(10, 0), (13, None), (None, 1)], "doc_id long, quality int")
    got = quality(odd_docs, labels).collect()
    pair_up([(r["doc_id"], r["lang"], r["n_bytes"], r["perplexity"], r["threshold"]) for r in got], brute_quality(odd_rows, good))
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in got)


def test_shares_of_a_context_sum_to_one(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("xyz ") for _ in range(300))
    model = Model(spark.createDataFrame([(text,)], "text string"))
    for context in (b"xyz", b"\n\nx", b"QQQ", b"Qxy"):
        rows = model.log10(spark.createDataFrame([(int.from_bytes(context + bytes([b]), "big"),) for b in range(256)], "gram long")).collect()
        assert len(rows) == 256 and abs(sum(10 ** r["log10"] for r in rows) - 1) < 1e-9


def test_slices_and_a_long_text(spark):
    """The same rows whatever the slices; one text is longer than a slice."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "".join(rng.choice("abc \n") for _ in range(n))) for i, n in enumerate([5, 0, 700, 90, 3000, 12])], "doc_id long, text string")
    model = Model(docs)
    one = sorted(map(tuple, perplexities(docs, model).collect()))
    more = sorted(map(tuple, perplexities(docs, model, slice_bytes=100).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in more] and [r[2] for r in one] == pytest.approx([r[2] for r in more])


def test_noise_goes_and_clean_text_stays(spark):
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice("the of and river stone cloud".split()) for _ in range(80))
    rows = [(i, clean(), "en") for i in range(300)] + [(i, clean().upper().replace(" ", "!! "), "en") for i in range(300, 330)] + [(400, clean(), None), (401, None, "fr"), (402, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality(docs, labels).collect()}
    assert sum(got[i] for i in range(150, 300)) >= 145 and not any(got[i] for i in range(300, 330)) and all(got[i] for i in (400, 401, 402))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (7, None)], "doc_id long, quality int")
    assert quality(odd_docs, labels).count() == len(odd_rows)
    assert quality(no_docs, labels).count() == 0
    assert all(r["kept"] for r in quality(odd_docs, labels.where("quality = 9")).collect())
