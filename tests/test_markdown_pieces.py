"""Markdown in pieces: the same lines as whole files, whatever the pieces are."""

import random

import pytest

from pagemill.operators import markdown
from pagemill.operators.markdown import START, step
from pagemill.operators.markdown_pieces import active_lines, after, composed, cut, function, lines_of

SIGNS = ["`", "``", "```", "````", "~~~", "~~~~~", "<!--", "-->", " ", "    ", "\t", "\n", "\n", "\n", "\n", "a", "### x", "Status: b"]


def some_text(rng, n=40):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, n)))


def states(rng):
    return [START, ("", 0, -1), *[("", 0, m) for m in range(1, 5)], *[(s, n, o) for s in "`~" for n in (3, 4, 5, 9) for o in (0, -1, 1, 3)]]


def walk(lines, state):
    for line in lines:
        state, _ = step(line, state)
    return state


def test_functions_give_what_a_walk_gives():
    rng = random.Random(8)
    for _ in range(400):
        lines = some_text(rng).splitlines()
        f = function(lines)
        for state in states(rng):
            assert after(f, state) == walk(lines, state), (lines, state)


def test_composition():
    import json

    rng = random.Random(9)
    for _ in range(200):
        parts = [some_text(rng, 20).splitlines() for _ in range(4)]
        fs = [json.loads(json.dumps(function(p))) for p in parts]
        left = composed(composed(composed(fs[0], fs[1]), fs[2]), fs[3])
        right = composed(fs[0], json.loads(json.dumps(composed(fs[1], composed(fs[2], fs[3])))))
        for state in states(rng):
            want = walk([x for p in parts for x in p], state)
            assert after(left, state) == want == after(right, state)
        assert left["lines"] == right["lines"] == sum(map(len, parts))


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(10)
    rows = [(f"f{i}", some_text(rng, 120)) for i in range(40)] + [("none", None), ("empty", ""), ("blank", "\n\n"), ("open", "a `b\nc"), ("tail", "x\r\ny\u2028z\x0c")]
    return rows, spark.createDataFrame(rows, "path string, text string").repartition(3)


@pytest.mark.parametrize(("lines", "group"), [(1, 2), (7, 3), (10**6, 1024)])
def test_same_lines_for_all_sizes(spark, files, lines, group):
    rows, df = files
    got = sorted(map(tuple, active_lines(cut(df, lines), group).collect()))
    assert got == sorted((p, n, t) for p, text in rows for n, t in markdown.active_lines(text or ""))


def test_conversations_whose_turns_are_pieces(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr("cast(conv_id as string) path", "turn piece", "text", "role")
    whole = {}
    for r in sorted(turns.collect(), key=lambda r: r["piece"]):
        whole.setdefault(r["path"], []).extend(lines_of(r["text"]))
    want = sorted((p, n, t) for p, own in whole.items() for n, t in markdown.active_lines("\n".join(own)))
    assert sorted(map(tuple, active_lines(turns).collect())) == want
    assert active_lines(turns.limit(0)).collect() == []


def test_a_fence_over_many_pieces(spark):
    text = "a\n````\n" + "```\nhidden\n~~~\n" * 50 + "`````\nb `x\n" + "in span\n" * 30 + "e` c\n"
    df = spark.createDataFrame([("f", text)], "path string, text string")
    got = sorted((r["line_no"], r["line"]) for r in active_lines(cut(df, 3), 4).collect())
    assert got == sorted(markdown.active_lines(text)) and got[0] == (1, "a") and got[-1][1].endswith(" c")


def test_query_against_whole_files(spark):
    """The query's files are made a second time in Python and read as a whole."""
    from binascii import crc32
    from hashlib import sha256

    from pagemill.plans import registry

    sf, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        path = f"{r['doc_id']}-{sha256(r['text'].encode()).hexdigest()[:8]}"
        kind, text = crc32(path.encode()) % 4, r["text"]
        text = "~~~~\n" + text.replace("\n", "\n~~~\n") if kind == 0 else "<!-- " + text.replace(". ", " -->\n<!--") if kind == 1 else text
        lines = list(markdown.active_lines(text))
        if lines:
            want[path] = (len(lines), sum(n for n, _ in lines), sum(crc32(x.encode()) for _, x in lines))
    assert {r["path"]: (r["lines"], r["line_nos"], r["crc"]) for r in registry.QUERIES["markdown_pieces"](spark, sf).collect()} == want
