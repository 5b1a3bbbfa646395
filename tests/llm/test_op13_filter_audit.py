import itertools
import random
import re

from pagemill.llm import op13_filter_audit as op
from pagemill.llm.op13_filter_audit import COLUMNS, ORDERS, audit, count_words, plain_changes

LABELS = "doc_id long, quality int, toxic int, part string"


def fails(doc, docs):
    words = re.findall(r"[^\x20\x09-\x0D]+", doc[1] or "")
    text = doc[1] or ""
    out = ""
    out += "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    out += "E" if doc[0] is not None and any(d[0] is not None and d[0] < doc[0] and (d[1] or "") == text for d in docs) else ""
    return out


def brute(docs, labels):
    """Every order applied to every document, one step after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = {}
    for part in {d[2] or "" for d in docs}:
        own = [(d, fails(d, docs)) for d in docs if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(out)
                rows[part, order, step] = [len(left), len(out), sum(f in x[1] for x in gone), sum(x[1] == f for x in own), sum(x[0][0] in good for x in out), sum(x[0][0] in toxic for x in out), f]
                gone += out
        for (p, _, _), v in rows.items():
            if p == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return sorted((*k, *v) for k, v in rows.items())


def check(spark, docs_df, docs, labels):
    got = audit(docs_df, spark.createDataFrame([(*x, "z") for x in labels], LABELS))
    assert got.columns == ["part", *COLUMNS]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)


def test_odd_rows(spark, odd_docs, odd_rows):
    labels = [(1, 1, 0), (4, 0, 1), (7, 1, 1), (7, 0, 0), (10, None, 1), (None, 1, 1), (16, 1, None), (999, 1, 1)]
    check(spark, odd_docs, [(r[0], r[1], r[3]) for r in odd_rows], labels)


def test_all_masks_in_several_parts(spark):
    rng = random.Random(6)
    docs = []
    for i in range(160):
        n = rng.choice([0, 3, 49, 50, 51, 80])
        pool = [f"w{k}" for k in range(rng.choice([5, 200]))]
        text = " ".join(rng.choice(pool) for _ in range(n)) + rng.choice(["", " #", " A|", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        docs.append((i // 2 if i % 9 == 0 else i, rng.choice([text, text, None, "same text"]), rng.choice([None, "", "a", "b"])))
    df = spark.createDataFrame([(i, t, s) for i, t, s in docs], "doc_id long, text string, source string").repartition(5)
    check(spark, df, docs, [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 160, 2)])


def test_thresholds_are_exact(spark):
    texts = [" ".join(f"w{k}" for k in range(50)), " ".join(["a"] * 35 + [f"w{k}" for k in range(64)] + ["b"]), " ".join(["a"] * 36 + [f"w{k}" for k in range(64)]), "A" + "b" * 19, "A" + "b" * 18, "É" * 19 + "Z", "É" * 20 + "ZZ"]
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    check(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), docs, [])


def test_empty_tables(spark, no_docs):
    assert audit(no_docs, spark.createDataFrame([], LABELS)).collect() == []


def test_walk_visits_every_order_by_swaps():
    for n in range(1, 6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for k in plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))
    assert len(ORDERS) == 120


def test_only_two_steps_are_worked_out_after_a_swap(monkeypatch):
    calls = []
    real = op.Walk.step
    monkeypatch.setattr(op.Walk, "step", lambda self, f, before: calls.append(f) or real(self, f, before))
    import numpy as np

    list(op.Walk(*[np.ones((1, 32), np.int64)] * 3, 5).run())
    assert len(calls) == 5 + 2 * 119


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = ("stone river cloud x\ty\n" * 3000).encode()
    want = count_words(text)
    monkeypatch.setattr(op, "WORD_PART", 7)
    assert count_words(text) == want == (15000, 5)
