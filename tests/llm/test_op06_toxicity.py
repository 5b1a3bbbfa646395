import random
import zlib

import numpy as np
import pytest

from pagemill.llm import op06_toxicity
from pagemill.llm.op06_toxicity import choose_words, drop_toxic, place_threshold, toxicity, train

BAD = ["grommet", "zarfle", "blinkered"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice("the of and river stone cloud open close".split()) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD) + rng.choice(["", "xa", "qo"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(corpus):
    _, labels, docs, marks = corpus
    got = {r["doc_id"]: r for r in toxicity(docs, marks).collect()}
    assert len(got) == 1500
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    own = [(got[d]["predicted"], t) for d, t in labels if got[d]["held_out"]]
    assert sum(p == t for p, t in own) / len(own) > 0.95


def test_scores_do_not_use_labels_of_held_out_rows(spark, corpus):
    _, labels, docs, marks = corpus
    other = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels], "doc_id long, toxic int")
    score = lambda m: {r["doc_id"]: r["score"] for r in toxicity(docs, m).collect()}
    assert score(marks) == score(other)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs, corpus):
    marks = corpus[3]
    assert toxicity(odd_docs, marks).count() == len(odd_rows)
    assert toxicity(no_docs, marks).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity(odd_docs, none).collect()} == {0}
    kept = drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)


def test_risk_stays_right_with_positives_in_the_unlabelled():
    rng = np.random.default_rng(0)
    bag = lambda bad: np.unique(np.concatenate([rng.integers(100, 300, 20), [1] if bad else []]).astype(np.uint32))
    model = train([bag(True) for _ in range(200)], [bag(rng.random() < 0.3) for _ in range(800)], 0.3)
    score = lambda b: model.intercept + sum(dict(zip(model.words.tolist(), model.weights.tolist(), strict=True)).get(w, 0) for w in b.tolist())
    assert np.mean([score(bag(True)) > 0 for _ in range(100)]) > 0.95 and np.mean([score(bag(False)) < 0 for _ in range(100)]) > 0.95


def plain_training(positive, unlabelled, words, prior, epochs, rate=0.05, decay=1e-3):
    """The same minimisation in plain Python: full batches, no numpy."""
    import math

    words = list(words)
    rows = lambda sets: [[1.0 if w in set(s.tolist()) else 0.0 for w in words] + [1.0] for s in sets]
    pos, unl = rows(positive), rows(unlabelled)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    w = [0.0] * len(words) + [math.log(prior / (1 - prior))]
    m, v = [0.0] * len(w), [0.0] * len(w)
    for t in range(1, epochs + 1):
        f = lambda r: sum(a * b for a, b in zip(r, w))
        loss = lambda z: math.log(1 + math.exp(-z))
        mean = lambda xs: sum(xs) / len(xs)
        bracket = mean([loss(-f(r)) for r in unl]) - prior * mean([loss(-f(r)) for r in pos])
        up = [prior * mean([-sigmoid(-f(r)) * r[k] for r in pos]) for k in range(len(w))]
        down = [mean([sigmoid(f(r)) * r[k] for r in unl]) - prior * mean([sigmoid(f(r)) * r[k] for r in pos]) for k in range(len(w))]
        g = [a + b if bracket >= 0 else -b for a, b in zip(up, down)]
        g = [x + (decay * w[k] if k < len(words) else 0) for k, x in enumerate(g)]
        m = [0.9 * a + 0.1 * x for a, x in zip(m, g)]
        v = [0.999 * a + 0.001 * x * x for a, x in zip(v, g)]
        w = [a - rate * (b / (1 - 0.9**t)) / (math.sqrt(c / (1 - 0.999**t)) + 1e-8) for a, b, c in zip(w, m, v)]
    return dict(zip(words, w)), w[-1]


@pytest.mark.parametrize("prior", [0.3, 0.9])  # with the larger one the bracket is negative at times
def test_training_against_plain_python(prior):
    rng = np.random.default_rng(4)
    bag = lambda bad: np.unique(np.concatenate([rng.integers(100, 130, 6), rng.choice([1, 2, 3], 2) if bad else []]).astype(np.uint32))
    positive, unlabelled = [bag(True) for _ in range(40)], [bag(rng.random() < 0.2) for _ in range(90)]
    words = choose_words(positive, unlabelled, 8)
    # the words by the same score, worked out one by one
    count = lambda sets, w: sum(w in s.tolist() for s in sets)
    z = {}
    for w in {int(x) for s in positive for x in s}:
        p, u, n, k = count(positive, w), count(unlabelled, w), len(positive), len(unlabelled)
        pool = (p + u + 1) / (n + k + 2)
        score = (p / n - u / k) / (pool * (1 - pool) * (1 / n + 1 / k)) ** 0.5
        if p >= 3 and score >= 5:
            z[w] = score
    assert words.tolist() == sorted(z, key=lambda w: (-z[w], w))[:8] and len(words)
    model = train(positive, unlabelled, prior, n_words=8, epochs=60)
    weights, intercept = plain_training(positive, unlabelled, words.tolist(), prior, 60)
    assert abs(model.intercept - intercept) < 1e-3
    assert all(abs(weights[w] - x) < 1e-3 for w, x in zip(model.words.tolist(), model.weights.tolist()))


def test_threshold_against_all_thresholds():
    rng = np.random.default_rng(6)
    bag = lambda p: np.flatnonzero(rng.random(12) < p).astype(np.uint32)
    model = train([bag(0.6) for _ in range(60)], [bag(0.3) for _ in range(200)], 0.3, n_words=12, epochs=20)
    toxic, clean = [bag(0.5) for _ in range(50)], [bag(0.35) for _ in range(80)]
    moved = place_threshold(model, toxic, clean)
    table = model.table()
    odds = lambda sets, base: [base + float(table[s].sum()) for s in sets]
    wrong = lambda base: sum(x < 0 for x in odds(toxic, base)) + sum(x >= 0 for x in odds(clean, base))
    tries = [model.intercept - x for x in np.linspace(-12, 12, 4001)]
    assert wrong(moved.intercept) <= min(map(wrong, tries))


def test_repeated_and_null_ids(spark, corpus):
    """Rows that repeat a doc_id are scored by their own texts and don't enlarge the sample."""
    rows, _, docs, marks = corpus
    more = spark.createDataFrame([(1, rows[3][1])] * 50 + [(None, rows[5][1]), (None, None)], "doc_id long, text string")
    got = toxicity(docs.unionByName(more), marks).collect()
    assert len(got) == 1552 and sum(r["doc_id"] is None for r in got) == 2 and len({r["score"] for r in got if r["doc_id"] == 1}) <= 2


def test_long_text(spark, corpus):
    rows, _, _, marks = corpus
    docs = spark.createDataFrame([*rows, (5000, "river stone " * 400_000 + "zarfle grommet zarfle"), (5001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, marks).where("doc_id >= 5000").collect()}
    assert 0 <= got[5001] < got[5000] <= 1


def test_choosing_words_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 22, 2000).astype(np.uint32)) for _ in range(1000)]
    tracemalloc.start()
    choose_words(sets[:500], sets[500:], 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # an array of all feature numbers in floats is 32 MB, and several were held


def test_whole_sets_are_not_gathered(spark, corpus, monkeypatch):
    """Training gets sets of the chosen words only, the same words as from the whole sets; before, the driver held all words of the sample."""
    docs, marks = corpus[2:]
    got, plain = {}, op06_toxicity.train

    def look(positive, unlabelled, prior, **more):
        got.update(more, sets=[*positive, *unlabelled])
        return plain(positive, unlabelled, prior, **more)

    monkeypatch.setattr(op06_toxicity, "train", look)
    op06_toxicity.fit(docs, marks)
    chosen = set(got["words"].tolist())
    assert chosen and all(set(s.tolist()) <= chosen for s in got["sets"])
    texts = {d: t for d, t in corpus[0]}
    sets = lambda ids: [np.frombuffer(r["words"], "<u4") for r in op06_toxicity.word_sets(spark.createDataFrame([(d, texts[d], 1) for d in ids], "doc_id long, text string, kind int")).collect()]
    toxic = [d for d, t in corpus[1] if t and zlib.crc32(str(d).encode()) % 5]
    assert set(choose_words(sets(toxic), sets(list(texts)), 1024).tolist()) == chosen
