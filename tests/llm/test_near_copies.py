import random
import re

import corpus_pipeline
from pagemill.llm.near_copies import near_copies
from pagemill.llm.op04_decontamination import drop_contaminated

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The least doc_id that each row reaches by pairs of an exact similarity of 0.8 or more."""
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    label = list(ids)
    while True:
        old = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == old:
            return dict(zip(ids, label)), len(pairs)


def edited(rng, text, edits):
    w = text.split()
    for at in rng.sample(range(len(w)), edits):
        w[at] = rng.choice(WORDS)
    return " ".join(w)


def corpus():
    """Copies on both sides of 0.8, in groups and in pairs, beside texts that share a passage."""
    rng, texts = random.Random(8), []
    for _ in range(120):
        base = " ".join(rng.choices(WORDS, k=rng.randint(30, 400)))
        texts += [base, *[edited(rng, base, max(1, round(len(base.split()) * share))) for share in (0.01, 0.02, 0.022, 0.025, 0.04)]]
    passage = " ".join(rng.choices(WORDS, k=60))
    texts += [passage + " " + " ".join(rng.choices(WORDS, k=30)) for _ in range(60)]
    texts += [None, "", " \t ", "one", "One", "one two three four", "one two three four five"]
    rng.shuffle(texts)
    return [(i + 10, t) for i, t in enumerate(texts)]


def test_links_are_those_of_exact_similarity(spark):
    rows = corpus()
    want, n_pairs = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert n_pairs > 300 and got == want


def test_the_stage_keeps_one_of_each_group_and_all_others(spark):
    rows = corpus()
    want, _ = brute(rows)
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert {r["doc_id"] for r in left.collect()} == {d for d, least in want.items() if d == least}


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert near_copies(odd_docs).count() == len(odd_rows)
    assert near_copies(no_docs).count() == 0


def test_rows_that_share_ids(spark):
    """Unrelated texts of one id, null ids and repeated rows: each row is judged by itself, one of equal rows stays."""
    a, b = (" ".join(random.Random(k).choices(WORDS, k=50)) for k in (1, 2))
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (None, b + " end"), (7, None), (7, "")]
    left = lambda docs: sorted(((r["doc_id"], r["text"], r["kept"]) for r in docs.collect()), key=str)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, kept int")
    assert left(corpus_pipeline.near_dedup(spark, docs, None)) in (sorted([(1, a, 5), (2, b, 5), (7, t, 5)], key=str) for t in (None, ""))
    assert left(corpus_pipeline.exact_dedup(spark, docs, None)) in (sorted([(2, a, 5), (2, b, 5), (None, b + " end", 5), (7, t, 5)], key=str) for t in (None, ""))


def test_contaminated_rows_go_one_by_one(spark, tmp_path):
    bench = " ".join(WORDS[:13])
    spark.createDataFrame([(1, bench), (2, " ".join(WORDS[40:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "clean text"), (1, bench + " more"), (None, bench), (None, None), (3, "x " * 300 + bench)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, row int")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = sorted([(1, "clean text"), (None, None), (3, "x " * 300 + bench)], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want
    more = drop_contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), block_bytes=30)
    assert sorted(((r["doc_id"], r["text"]) for r in more.collect()), key=str) == want


def test_recall_of_planted_copies(spark):
    """Copies with one word in a hundred changed, of texts of 100 to 600 words: their similarity is mostly 0.8 or more."""
    rng, rows, planted = random.Random(12), [], 0
    for i in range(300):
        base = " ".join(rng.choices(WORDS, k=rng.randint(100, 600)))
        copy = edited(rng, base, max(1, len(base.split()) // 100))
        x, y = shingles(base), shingles(copy)
        planted += 5 * len(x & y) >= 4 * len(x | y)
        rows += [(2 * i, base), (2 * i + 1, copy)]
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id <> component_id").count()
    assert found == planted > 290
