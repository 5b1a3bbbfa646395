"""Line deduplication by a log-template tree, with DataFrame operations only.

A line's tokens are what white space parts; a token with a digit is a field, ``<*>``. The
tree has a fixed depth: the root branches on the token count, the next levels on the
first ``depth`` tokens, and a leaf holds the kinds of line that agree in all of these.

A leaf holds any number of templates. Two kinds are of one template if they agree in ``similarity`` of
their places, so of ``n`` tokens ``d`` may differ. A line's tokens after the first ones are cut into
``d + 1`` segments, and kinds that differ in no more than ``d`` places agree in all of one segment: the kinds
of a leaf that share one are a branch (the whole leaf is one too). The line of a branch that stands in the most
documents (of equals, that with the greatest MD5) is the template's first form; a line of the branch
belongs to the template if it agrees with it in ``similarity`` of the places, and the places where it does not are variable
fields. A line also stands for its own template, with fields only where digits are.

A template recurs if lines of at least ``min_docs`` documents belong to it, two by default. Every line of a
recurring template is dropped, wherever it stands: copies of a text lose all they share. Lines of fewer than
``min_tokens`` tokens are left alone; by default only blank lines are.

The tree is never held anywhere: counts are grouped sums that are combined before the
shuffle. Lines are compared by two 64-bit hashes. The tokens of a line are only taken
apart in leaves that enough documents share, once for each kind of line, and a kind is compared with the first
forms of its branches, never with all other kinds. A form that very many lines are compared with is dealt to several tasks.

Cases: a null text counts as empty and has one empty line; blank lines stay; rows that repeat a
doc_id count as one document; a null doc_id counts as one document; texts keep their other bytes;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import maybe_in
from .session import cut, written

FIELD = "<*>"


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _generalised(text: Column) -> Column:
    """The text's lines with one space between tokens, and fields in place of tokens that have digits.

    Plain searches come first: few texts have other white space, and few lines have digits.
    """
    odd = lambda t: t.contains("  ") | t.contains("\t") | t.contains("\r") | t.contains("\x0b") | t.contains("\f")
    spaced = _once(text, lambda t: F.when(odd(t), F.regexp_replace(t, "[ \t\x0b\f\r]+", " ")).otherwise(t))
    lines = F.transform(F.split(spaced, "\n"), lambda x: F.trim(x))
    return F.transform(lines, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "[^ 0-9]*[0-9][^ ]*", FIELD)).otherwise(x))


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int) -> DataFrame:
    """``doc_id, line_no, whole, n_tokens`` and hashes of leaf and line, for lines of enough tokens."""
    counted = F.transform(_generalised(F.coalesce(text_col, F.lit(""))), lambda x: F.struct(x.alias("whole"), (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + F.lit(1)).alias("n")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), F.posexplode(counted).alias("line_no", "l"))
    rows = rows.where((F.col("l.n") >= min_tokens) & (F.col("l.whole") != "")).select("doc_id", "text_key", "line_no", F.col("l.n").alias("n_tokens"), F.col("l.whole").alias("whole"))
    lead = F.substring_index("whole", " ", depth)
    return rows.select(
        "doc_id", "text_key", "line_no", "n_tokens", "whole",
        F.xxhash64("n_tokens", lead).alias("leaf1"), F.xxhash64(lead, "n_tokens").alias("leaf2"),
        F.xxhash64("whole").alias("line1"), F.xxhash64(F.lit(1), "whole").alias("line2"),
    )


LEAF, LINE, FORM = ["leaf1", "leaf2"], ["line1", "line2"], ["form1", "form2"]
#: Lines that are compared with one form in one task.
SHARE = 512


def _branches(kinds: DataFrame, depth: int, spare: Column) -> DataFrame:
    """``branch, n_docs, tie, line1, line2``: the whole leaf and each segment of each kind."""
    n_rest = F.greatest(F.lit(0), F.col("n_tokens") - F.lit(depth))
    begin = lambda s: F.floor((s * n_rest + spare) / (spare + 1)).cast("int")
    segment = lambda rest, s: F.xxhash64(*LEAF, s, F.concat_ws(" ", F.slice(rest, begin(s) + 1, begin(s + 1) - begin(s))))
    rest = F.slice(F.split("whole", " "), depth + 1, F.greatest(F.lit(1), F.col("n_tokens")))
    segments = _once(rest, lambda rest: F.transform(F.sequence(F.lit(0), spare), lambda s: segment(rest, s)))
    return kinds.select(F.explode(F.concat(F.array(F.xxhash64(*LEAF)), segments)).alias("branch"), "n_docs", "tie", *LINE)


def _templates(kinds: DataFrame, depth: int, per_mille: int) -> DataFrame:
    """``form1, form2, line1, line2``: the lines of each template, its first form among them, from ``kinds`` of shared leaves."""
    spare = F.floor(F.col("n_tokens") * (1000 - per_mille) / 1000).cast("int")
    branches = written(_branches(kinds.where(spare > 0), depth, spare))
    first = branches.groupBy("branch").agg(F.count("*").alias("n"), F.max(F.struct("n_docs", "tie", *LINE)).alias("m")).where("n > 1")
    pairs = branches.select("branch", *LINE).join(first.select("branch", F.col("m.line1").alias("form1"), F.col("m.line2").alias("form2")), "branch")
    pairs = cut(pairs.where("line1 <> form1 or line2 <> form2").select(*LINE, *FORM).distinct())

    # tokens of a line and of a form meet; a form with many lines goes to as many tasks as it takes
    forms = pairs.groupBy(FORM).agg(F.ceil(F.count("*") / F.lit(SHARE)).cast("int").alias("shares"))
    texts = kinds.select(*LINE, "n_tokens", "whole")
    form_texts = texts.select(F.col("line1").alias("form1"), F.col("line2").alias("form2"), F.col("whole").alias("form")).join(forms, FORM)
    form_texts = form_texts.select(*FORM, "form", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(forms, FORM).withColumn("share", F.pmod("line1", "shares").cast("int")).drop("shares")
    met = dealt.join(texts, LINE).join(form_texts, [*FORM, "share"])
    same = F.aggregate(F.zip_with(F.split("whole", " "), F.split("form", " "), lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)
    alike = cut(met.where(same * 1000 >= F.col("n_tokens") * per_mille).select(*FORM, *LINE))
    return alike.unionByName(alike.select(*FORM, F.col("form1").alias("line1"), F.col("form2").alias("line2")).distinct())


def recurring_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.8, min_docs: int = 2, min_tokens: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, line_no`` of every line to drop (line_no from 0; text_key is the text's hash); similarity counts in thousandths."""
    lines = _lines(docs, id_col, text_col, depth, min_tokens)
    marks = written(lines.select("doc_id", "text_key", "line_no", *LEAF, *LINE))
    seen = written(marks.select(*LEAF, *LINE, "doc_id").distinct())
    kinds = seen.groupBy(*LEAF, *LINE).agg(F.count("*").alias("n_docs"))
    own = kinds.where(F.col("n_docs") >= min_docs).select(LINE)

    # leaves with more than one kind of line that enough documents may share
    shared = kinds.groupBy(LEAF).agg(F.count("*").alias("kinds"), F.sum("n_docs").alias("docs")).where((F.col("kinds") > 1) & (F.col("docs") >= min_docs)).select(LEAF)
    inside = cut(kinds.join(shared, LEAF, "left_semi"))
    # a task folds a common line's places before they are sent
    texts = maybe_in(lines.select(*LINE, "n_tokens", "whole"), inside, "line1").dropDuplicates(LINE).join(inside, LINE)
    tie = F.conv(F.substring(F.md5("whole"), 1, 15), 16, 10).cast("long")
    members = cut(_templates(written(texts.withColumn("tie", tie)), depth, round(similarity * 1000)))
    held = maybe_in(seen.select(*LINE, "doc_id"), members, "line1").join(members, LINE).select(*FORM, "doc_id").distinct()
    recurring = held.groupBy(FORM).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    wide = members.join(recurring, FORM, "left_semi").select(LINE)

    drop = cut(own.unionByName(wide).distinct())
    return maybe_in(marks.select("doc_id", "text_key", "line_no", *LINE), drop, "line1").join(drop, LINE, "left_semi").select("doc_id", "text_key", "line_no")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The columns of ``docs`` with the lines dropped from the text, and ``n_lines, n_dropped``."""
    found = recurring_lines(docs, id_col=id_col, text_col=text_col, **parameters)
    per_doc = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("line_no").alias("__drop"))
    both = docs.join(per_doc, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text_col, F.lit(""))) == F.col("__key")), "left").withColumn("__lines", F.split(F.coalesce(text_col, F.lit("")), "\n"))
    # the places that stay come from one pass over sets: a text may have millions of lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    both = both.withColumn("__text", text).withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", F.size(F.coalesce("__drop", F.array().cast("array<int>"))).cast("long"))
    return both.select(*[F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns], "n_lines", "n_dropped")
