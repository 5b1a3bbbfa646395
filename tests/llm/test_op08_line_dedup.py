import re
from collections import defaultdict
from hashlib import md5

import pytest

from pagemill.llm.op08_line_dedup import drop_recurring_lines


def brute(rows, depth, similarity, min_docs, min_tokens):
    """The same rules in plain Python; returns the texts that are left."""
    def toks(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0b\f\r]+", line) if t]

    kind_docs, kinds = defaultdict(set), defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            t = tuple(toks(line))
            if t and len(t) >= min_tokens:
                leaf = (len(t), t[:depth])
                kind_docs[t].add(doc)
                kinds[leaf].add(t)
    gone = {t for t, d in kind_docs.items() if len(d) >= min_docs}
    for (n, lead), members in kinds.items():
        spare = n * (1000 - round(similarity * 1000)) // 1000
        branches = defaultdict(set)
        for t in members if spare and len(members) > 1 else ():
            rest = t[depth:]
            branches[None].add(t)
            for s in range(spare + 1):
                lo, hi = ((x * len(rest) + spare) // (spare + 1) for x in (s, s + 1))
                branches[s, rest[lo:hi]].add(t)
        forms = defaultdict(set)
        for b in branches.values():
            form = max(b, key=lambda t: (len(kind_docs[t]), md5(" ".join(t).encode()).hexdigest()[:15]))
            forms[form] |= {t for t in b if sum(x == y for x, y in zip(t, form, strict=True)) * 1000 >= n * round(similarity * 1000)}
        for found in forms.values():
            if len(found) > 1 and len(set().union(*(kind_docs[t] for t in found))) >= min_docs:
                gone |= found
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if tuple(toks(x)) not in gone]
        out.append((doc, text if len(left) == len(lines) else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


LOGS = [(100 + i, f"user {i} logged in from 10.0.0.{i} at gate red\nown line number {i} of this text only here\n  user x{i}  logged in from home at gate red\nlog entry for {'abcdefghij'[i]} was closed by the clerk today ok", "en", "s", 1) for i in range(10)]


@pytest.mark.parametrize(("similarity", "min_docs", "min_tokens"), [(0.8, 3, 4), (0.5, 4, 2), (0.8, 2, 1)])
def test_against_brute_force(spark, odd_docs, odd_rows, similarity, min_docs, min_tokens):
    rows = [*odd_rows, *LOGS]
    from pyspark.sql import functions as F

    more = spark.createDataFrame(LOGS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(more.select("*", *[F.lit(7).alias(c) for c in odd_docs.columns[5:]]))
    got = drop_recurring_lines(docs.drop("n_lines"), similarity=similarity, min_docs=min_docs, min_tokens=min_tokens)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == brute(rows, 3, similarity, min_docs, min_tokens)


def test_variable_fields_are_generalised(spark):
    docs = spark.createDataFrame(LOGS, "doc_id long, text string, lang string, source string, n_chars long")
    left = [r["text"] for r in drop_recurring_lines(docs, min_docs=10).collect()]
    assert all("clerk" not in t and "10.0.0" not in t for t in left)


def test_a_leaf_holds_several_templates(spark):
    """Templates with one leaf, each in two documents, among lines of the leaf that are all different."""
    words = lambda i, n: [f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(n)]
    one = [" ".join(["the", "job", "of", *words(i, 4), "x" if j else "y", *words(i + 200, 4)]) for i in range(20) for j in (0, 1)]
    alone = [" ".join(["the", "job", "of", *words(400 + i, 9)]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([*one, *alone])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(docs).collect()}
    assert got == {i: int(i < 40) for i in range(100)}


def test_two_documents_and_short_lines(spark):
    docs = spark.createDataFrame([(1, "Menu\n\nown words\nHome page"), (2, "Menu\n\nother\n  Home  page "), (3, "alone\nalone")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in drop_recurring_lines(docs).collect()} == {1: "\nown words", 2: "\nother", 3: "alone\nalone"}


def test_a_text_of_very_many_lines(spark):
    """Linear in a text's lines: half of 80,000 stand in another text too."""
    n = 80_000
    texts = [(1, "\n".join(f"own{chr(97 + i % 26)} x{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}" for i in range(n))), (2, "\n".join(f"own{chr(97 + i % 26)} x{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576 % 26)}" for i in range(0, n, 2)))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["text"])) for r in drop_recurring_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1][:2] == (n, n // 2) and got[2] == (n // 2, n // 2, 0)
    assert got[1][2] == sum(len(x) for x in texts[0][1].split("\n")[1::2]) + n // 2 - 1


def test_empty_table(no_docs):
    assert drop_recurring_lines(no_docs).count() == 0


def test_plan_has_no_python(odd_docs):
    plan = drop_recurring_lines(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
