import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import ordered, ranges
from pagemill.operators.pages import BASE_SIZES, Policy, batch_plan, batch_sizes, classify, page_features, page_index
from pagemill.sources import files

TEXTS = ["A short sentence of prose.", "Equation x = y and y^2 = z hold here.", "", "name   age   town\nann   30   york", "More short prose.", "And some more."]


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], "source_id string, page int, text string")


def test_pages_of_every_kind(spark):
    rows = classify(page_features(frame(spark, TEXTS)), Policy()).orderBy("page").collect()
    assert [r["complexity"] for r in rows] == ["low", "medium", "critical", "medium", "low", "low"]
    assert [r["route"] for r in rows] == ["digital-text", "math-heavy", "visual-transcription", "table-heavy", "digital-text", "digital-text"]
    assert [r["formula_markers"] for r in rows] == [0, 4, 0, 0, 0, 0] and rows[3]["table_lines"] == 2
    assert rows[2]["reason_codes"] == ["empty-text-layer"] and rows[1]["complexity_score"] == 5
    plan = batch_plan(classify(page_features(frame(spark, TEXTS)), Policy())).orderBy("batch_id").collect()
    assert [r["owned_pages"] for r in plan] == [[1], [2], [3], [4], [5, 6]]
    assert [r["context_pages"] for r in plan] == [[2], [1, 3], [2, 4], [3, 5], [4]]
    assert [r["worker_mode"] for r in plan] == ["single-page"] * 4 + ["batch"]


def test_scans_are_batched(spark):
    rows = classify(page_features(frame(spark, [""] * 6)), Policy("scanned", ("book", "math-heavy")))
    assert {(r["complexity"], r["route"], tuple(r["reason_codes"]), r["complexity_score"]) for r in rows.collect()} == {("high", "visual-transcription", ("empty-text-layer", "scanned-source", "math-trait"), 6)}
    assert sorted(r["owned_pages"] for r in batch_plan(rows).collect()) == [[1, 2, 3, 4, 5], [6]]


def test_mixed_empty_page_and_plain_page(spark):
    rows = classify(page_features(frame(spark, [None, "word " * 100])), Policy("mixed")).orderBy("page").collect()
    assert rows[0]["reason_codes"] == ["empty-text-layer", "mixed-source", "mixed-empty-page"] and rows[0]["complexity"] == "high"
    rows = classify(page_features(frame(spark, ["word " * 100])), Policy()).collect()
    assert rows[0]["reason_codes"] == ["ordinary-digital-text"]


@pytest.mark.parametrize(("kind", "traits", "sizes", "want"), [
    ("digital", (), {}, (35, 12, 6, 1)), ("digital", ("book", "math-heavy"), {}, (25, 10, 5, 1)), ("unknown", ("book", "visual-complex"), {}, (40, 8, 4, 1)), ("scanned", ("cjk",), {"low": 2, "medium": 2, "high": 2}, (12, 8, 6, 1)),
    ("mixed", ("long-document",), {"low": 2, "medium": 2, "high": 2, "critical": 0}, (40, 12, 6, 1)), ("digital", ("encoded-math",), {"low": 2, "high": 2}, (25, 10, 4, 1)),
])
def test_sizes(spark, kind, traits, sizes, want):
    got = batch_sizes(F.lit(kind), F.array(*map(F.lit, traits)).cast("array<string>"), sizes)
    assert tuple(spark.range(1).select(*[got[k].alias(k) for k in ("low", "medium", "high", "critical")]).first()) == ((25,) + want[1:] if (kind, sizes.get("low")) == ("digital", 2) else want)


def test_unknown_policies():
    for bad in (("paper", ()), ("digital", ("odd",))):
        with pytest.raises(ValueError):
            Policy(*bad)


def test_plan_is_the_fold(spark):
    """Random classes in several sources, with chunks so small that runs cross them."""
    rng = random.Random(1)
    rows = [(s, p, rng.choice("ab" if rng.random() < 0.1 else "a"), "r", rng.randint(1, 3), 5) for s in "xyz" for p in range(1, rng.randint(2, 120))]
    size = {"a": 7, "b": 3}
    df = spark.createDataFrame([(s, p, c, r, size[c], n) for s, p, c, r, _, n in rows], "source_id string, page int, complexity string, route string, recommended_batch_size int, text_chars int")
    want = []
    for s in "xyz":
        batch = []
        for _, p, c, *_ in [r for r in rows if r[0] == s]:
            if batch and (batch[0][1] != c or len(batch) >= size[batch[0][1]]):
                want.append((s, [x[0] for x in batch]))
                batch = []
            batch.append((p, c))
        want.append((s, [x[0] for x in batch]))
    for chunk in (1 << 16, 5):
        for gap_free in (True, False):
            got = batch_plan(df, chunk=chunk, gap_free=gap_free).collect()
            assert sorted((r["source_id"], r["owned_pages"]) for r in got) == sorted(want)
            assert all(not set(r["owned_pages"]) & set(r["context_pages"]) for r in got)


def test_index_document(spark):
    import json

    doc = json.loads(page_index(classify(page_features(frame(spark, TEXTS)), Policy()), Policy()).first()["document"])
    assert doc["page_count"] == 6 and len(doc["pages"]) == 6 and doc["policy"]["batch_sizes"] == BASE_SIZES and doc["batches"][-1]["owned_pages"] == [5, 6]


def test_form_feeds(spark):
    texts = spark.createDataFrame([("a", "one\ftwo\f\f"), ("b", "one\f\ftwo\f"), ("c", "x"), ("d", "")], "path string, text string")
    counts = spark.createDataFrame([("a", 2), ("b", 4), ("c", 2), ("d", 1)], "path string, page_count int")
    got = sorted(tuple(r) for r in files.form_feed_pages(texts, counts).collect())
    assert got == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "one"), ("b", 2, ""), ("b", 3, "two"), ("b", 4, ""), ("d", 1, "")]
    assert [r[0] for r in files.unusable_separators(texts, counts).collect()] == ["c"]


def test_selection_and_ranges(spark):
    req = spark.createDataFrame([(1, "1-3,2,3-4", 5), (2, "6", 5), (3, "4-2", 5), (4, "x,1", 5), (5, " 2 , 4-5", 5), (6, "0", 5)], "request_id int, selection string, page_count int")
    got = ranges.selected_pages(req)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 2), (5, 4), (5, 5)]
    assert sorted(tuple(r) for r in ranges.selection_violations(req).collect()) == [(2, "page-out-of-bounds"), (3, "reversed-range"), (4, "malformed-token"), (6, "malformed-token")]
    assert sorted(tuple(r) for r in ranges.contiguous_ranges(got, ["request_id"], chunk=2).collect()) == [(1, 1, 4, 4), (5, 2, 2, 1), (5, 4, 5, 2)]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_running_values(spark, chunk):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 9)) for k in (1, None) for i in range(40)]
    df = ordered.with_chunk(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], chunk)
    df = ordered.ordinal(df, ["k"], ["i"], "n")
    df = ordered.previous(df, ["k"], ["i"], F.col("v"), "p")
    df = ordered.running_max(df, ["k"], ["i"], F.col("v"), "m")
    df = ordered.running_sum(df, ["k"], ["i"], F.col("v"), "s")
    got = {(r["k"], r["i"]): (r["n"], r["p"], r["m"], r["s"]) for r in df.collect()}
    for k in (1, None):
        v = [x for kk, _, x in rows if kk == k]
        for i in range(40):
            assert got[k, i] == (i + 1, v[i - 1] if i else None, max(v[: i + 1]), sum(v[: i + 1]))


def test_chunks_hold_rows_whatever_the_keys_are(spark):
    """Hashed and huge order values of one key, dense ones of another: chunks are even, values are right."""
    n = 20_000
    hashed = spark.range(n).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("i"), (F.col("id") % 10).alias("v"))
    df = hashed.unionByName(spark.range(300).select(F.lit("small").alias("k"), F.col("id").alias("i"), (F.col("id") % 3).alias("v")))
    dealt = ordered.with_chunk(df, ["k"], ["i"], 1000)
    sizes = [r["count"] for r in dealt.groupBy("__chunk").count().collect()]
    assert 15 <= len(sizes) <= 21 and max(sizes) < 2500
    mark = F.when(F.col("v") == 0, F.col("i"))
    got = ordered.last_value(ordered.running_sum(ordered.ordinal(dealt, ["k"], ["i"], "n"), ["k"], ["i"], F.col("v"), "s"), ["k"], ["i"], mark, "z")
    want, rows = {}, {}
    for r in df.collect():
        rows.setdefault(r["k"], []).append((r["i"], r["v"]))
    for k, own in rows.items():
        total, last = 0, None
        for at, (i, v) in enumerate(sorted(own), 1):
            total, last = total + v, i if v == 0 else last
            want[k, i] = (at, total, last)
    assert {(r["k"], r["i"]): (r["n"], r["s"], r["z"]) for r in got.collect()} == want
