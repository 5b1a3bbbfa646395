"""Range unions, histograms, lookups in order, ordered contracts, and rules by bit sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import ranges, raster, rules
from pagemill.sources import files


def union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_range_union_and_depth(spark, chunk):
    rng = random.Random(1)
    spans = {k: [(a, a + rng.randint(0, 6)) for a in (rng.randint(1, 60) for _ in range(rng.randint(1, 25)))] for k in ("x", "y", None)}
    df = spark.createDataFrame([(k, a, b) for k, own in spans.items() for a, b in own], "k string, first long, last long").repartition(3)
    got = {}
    for r in ranges.merged_ranges(df, "k", chunk).collect():
        got.setdefault(r["k"], []).append((r["first_page"], r["last_page"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: union(v) for k, v in spans.items()}
    depth = {}
    for r in ranges.range_depths(df, "k", chunk).collect():
        for p in range(r["first_page"], r["last_page"] + 1):
            assert (r["k"], p) not in depth
            depth[r["k"], p] = r["depth"]
    want = {}
    for k, own in spans.items():
        for a, b in own:
            for p in range(a, b + 1):
                want[k, p] = want.get((k, p), 0) + 1
    assert depth == want
    assert ranges.merged_ranges(df.limit(0), "k").collect() == []


def test_long_ranges_take_no_row_for_each_page(spark):
    req = spark.createDataFrame([(1, "1-1000000000, 999999999-1500000000,1600000000", 2_000_000_000), (2, "5,4-4", 9), (3, "9-1", 9), (4, "1-99999999999999999999", 9)], "request_id int, selection string, page_count int")
    assert sorted(map(tuple, ranges.selected_ranges(req).collect())) == [(1, 1, 1500000000), (1, 1600000000, 1600000000), (2, 4, 5)]
    assert sorted(map(tuple, ranges.selection_violations(req).collect())) == [(3, "reversed-range"), (4, "malformed-token")]


def coverage(values, maximum):
    if not values:
        return None
    best = max(dict.fromkeys(values), key=lambda v: (values.count(v), -values.index(v)))
    return best, sum(abs(v - best) > max(1, maximum // 64) for v in values) / len(values)


def test_histograms_and_coverage(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0, 1, 5, 200, -3, 65535]) for _ in range(rng.randint(0, 30))]) for i in range(600)] + [(700, None), (701, [7, None, 7, None, None, 9])]
    df = spark.createDataFrame(rows, "id int, samples array<int>").repartition(3)
    assert {r["id"]: len(r["h"]) for r in raster.histograms(df, ["id"]).collect()} == {i: len(set(v or []) - {None}) for i, v in rows}
    for maximum in (255, 65535):
        got = {r["id"]: (r["background"], r["coverage"]) for r in raster.pixel_coverage(df, "id", maximum=maximum).collect()}
        want = {i: coverage([x for x in v or [] if x is not None], maximum) for i, v in rows}
        assert got == {i: w for i, w in want.items() if w}
    assert "Exchange" not in raster.pixel_coverage(df.limit(600).select("*"), "id")._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_of_one_raster(spark):
    rng = random.Random(3)
    tiles = [(k, t, [rng.choice([1, 2, 90]) for _ in range(rng.randint(0, 9))]) for k in "ab" for t in (3, 1, 2, 10)]
    df = spark.createDataFrame(tiles, "id string, tile int, samples array<int>").repartition(4)
    got = {r["id"]: (r["background"], r["coverage"]) for r in raster.pixel_coverage(df, "id", tile="tile").collect()}
    assert got == {k: coverage([v for _, _, own in sorted(t for t in tiles if t[0] == k) for v in own], 255) for k in "ab"}


def test_ordered_lookups(spark):
    values = spark.createDataFrame([("/p/a/x.log", "f.bib"), ("/p/a/x.log", "../g.bib"), ("/p/b/y.log", "f.bib"), ("/p/b/y.log", "f.bib"), ("/p/b/y.log", "h.sty"), ("/p/b/y.log", "/q/./r/../z"), ("/p/b/y.log", "no")], "path string, value string")
    present = spark.createDataFrame([("/p/a/f.bib",), ("/p/f.bib",), ("/lib/f.bib",), ("/p/g.bib",), ("/lib/h.sty",), ("/lib/h.sty",)], "path string")
    found = spark.createDataFrame([("no", "/sys/no"), ("no", "/sys/late"), ("h.sty", "/sys/h")], "name string, found string")

    def go(**extra):
        return {(r["path"][3], r["value"]): (r["resolved"], r["found_in"]) for r in files.resolve_inputs(values, present, "/p", **extra).collect()}

    got = go(roots=[files.BESIDE, "/lib", "/p"], lookups=found)
    assert got == {("a", "f.bib"): ("/p/a/f.bib", "beside"), ("a", "../g.bib"): ("/p/g.bib", "beside"), ("b", "f.bib"): ("/lib/f.bib", "/lib"), ("b", "h.sty"): ("/lib/h.sty", "/lib"), ("b", "/q/./r/../z"): ("/q/z", "absolute"), ("b", "no"): ("/sys/late", "lookup")}
    got = go()
    assert got["b", "f.bib"] == ("/p/f.bib", "/p") and got["b", "h.sty"] == ("/p/h.sty", None) and got["b", "no"] == ("/p/no", None)


def test_paths(spark):
    paths = ["/a/b/../c", "a/./b", "../x", "a/../../y", "/..", "/", "", "a//b/", "x.tar.gz", "/d/.hid", "noext", "a/b.c/d"]
    import os
    import posixpath

    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.normal_path(F.col("p")).alias("n"), tx.parent(F.col("p")).alias("d"), tx.stem(F.col("p")).alias("s")).collect()
    for r in rows:
        want = posixpath.normpath(r["p"]) if r["p"] else ""
        assert r["n"] == ("" if want == "." else want), r
    assert {r["p"]: r["d"] for r in rows if r["p"] in ("/a/b/../c", "a/./b", "noext", "/", "a//b/")} == {"/a/b/../c": "/a/b/..", "a/./b": "a/.", "noext": ".", "/": "/", "a//b/": "a"}
    assert {r["p"]: r["s"] for r in rows if r["p"] in ("x.tar.gz", "noext", "a/b.c/d")} == {"x.tar.gz": "x.tar", "noext": "noext", "a/b.c/d": "d"}
    assert os.sep == "/"


SCHEMA = "c string, id string, no int, v string, w int"


def test_ordered_differences(spark):
    expected = [("k", i, n, "v", n) for n, i in enumerate("abcdef")] + [("l", "a", 0, "v", None)]
    actual = [("k", "a", 0, "v", 0), ("k", "c", 1, "v", 2), ("k", "e", 2, "v", 4), ("k", "d", 3, "x", None), ("k", "f", 4, "v", 5), ("k", "new", 5, "v", 1), ("l", "a", 7, "v", None)]
    e, a = spark.createDataFrame(expected, SCHEMA), spark.createDataFrame(actual, SCHEMA)
    got = sorted(tuple(r) for r in rules.ordered_differences(a, e, ["c"], "id", "no", ["v", "w"], chunk=2).fillna(-1).collect())
    assert got == [("k", "b", "missing", 1, -1), ("k", "d", "changed:v,w", 3, 3), ("k", "d", "moved", 3, 3), ("k", "e", "moved", 4, 2), ("k", "new", "unexpected", -1, 5)]
    assert rules.ordered_differences(e, e, ["c"], "id", "no", ["v", "w"]).collect() == []


def test_contract_against_the_rules(spark):
    def contract(change):
        rows = list(rules.FILE_RULES)
        return rules.contract_differences(rules.rule_table(spark, change(rows)), rules.rule_table(spark, rules.FILE_RULES))

    assert contract(lambda r: r).collect() == []
    assert [tuple(x)[:2] for x in contract(lambda r: r[:3] + r[4:]).collect()] == [(rules.FILE_RULES[3][0], "missing")]
    assert {tuple(x)[:2] for x in contract(lambda r: [r[1], r[0], *r[2:]]).collect()} == {(r[0], "moved") for r in rules.FILE_RULES[:2]}
    assert [tuple(x)[:2] for x in contract(lambda r: [("all-projects", {}, ("other.tex",)), *r[1:]]).collect()] == [("all-projects", "changed:required")]
    assert [tuple(x)[:2] for x in contract(lambda r: [*r, ("more", {"operation": ("review",)}, ("x",))]).collect()] == [("more", "unexpected")]


def meets(rule, context):
    for f in rules.FIELDS[:5]:
        if f in rule and context[f] not in rule[f]:
            return False
    traits = context["traits"]
    if "traits_any" in rule and not set(rule["traits_any"]) & set(traits or ()):
        return False
    return "traits_all" not in rule or (traits is not None and set(rule["traits_all"]) <= set(traits))


def some_contexts(rng, n):
    names = [*rules.VALUES["traits"], "other"]
    return [(i, *[rng.choice([*rules.VALUES[f], None, "odd"]) for f in rules.FIELDS[:5]], rng.choice([None, rng.sample(names, rng.randint(0, 4))])) for i in range(n)]


def some_rules(rng, n):
    out = []
    for i in range(n):
        when = {f: tuple(rng.sample(rules.VALUES[f], rng.randint(1, 2))) for f in rules.FIELDS[:5] if rng.random() < 0.5}
        for f in ("traits_any", "traits_all"):
            if rng.random() < 0.4:
                when[f] = tuple(rng.sample([*rules.VALUES["traits"], "unseen"], rng.randint(1, 2)))
        out.append((f"r{i}", when, (f"f{i % 7}",)))
    return out


CONTEXT = "context_id int, " + ", ".join(f"{f} string" for f in rules.FIELDS[:5]) + ", traits array<string>"


@pytest.mark.parametrize("n", [0, 1, 64, 300])
def test_rule_index_against_a_loop(spark, n):
    rng = random.Random(n)
    contexts, own = some_contexts(rng, 1500), some_rules(rng, n)
    df = spark.createDataFrame(contexts, CONTEXT).repartition(3)
    got = sorted((r["context_id"], r["__rule_no"]) for r in rules.matching_rules(df, rules.rule_table(spark, own)).collect())
    fields = ["context_id", *rules.FIELDS[:5], "traits"]
    want = sorted((c[0], k) for c, (k, (_, when, _)) in itertools.product(contexts, enumerate(own)) if meets(when, dict(zip(fields, c))))
    assert got == want
    assert rules.matching_rules(df.limit(0), rules.rule_table(spark, own)).collect() == []


def test_ten_thousand_rules_without_a_nested_loop(spark):
    rng = random.Random(5)
    contexts, own = some_contexts(rng, 200), some_rules(rng, rules.MAX_RULES)
    table = rules.rule_table(spark, own).cache()
    found = rules.matching_rules(spark.createDataFrame(contexts, CONTEXT), table)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    fields = ["context_id", *rules.FIELDS[:5], "traits"]
    want = sum(meets(when, dict(zip(fields, c))) for c in contexts for _, when, _ in own)
    assert found.count() == want
    with pytest.raises(ValueError, match="over"):
        rules.matching_rules(spark.createDataFrame(contexts, CONTEXT), table.union(table.limit(1)))
