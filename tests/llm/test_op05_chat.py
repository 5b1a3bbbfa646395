import hashlib

import pytest

from pagemill.llm import op05_chat as chat


def render(source, **scope):
    return list(chat.compile_template(source)(scope))


def text(source, **scope):
    return "".join(t for t, _ in render(source, **scope))


def test_language():
    assert text("{% for x in xs %}{{ loop.index }}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{% endfor %}", xs=iter("abc")) == "1<2-3>"
    assert text("{% set a = 'x' ~ 1 + 2 %}{{ a | upper }}{{ m['k'].z }}", m={"k": {"z": None}}) == "X12"
    assert text("{{ not a and (b == 'q' or 'q' in b) }}", a=False, b="aqa") == "true"


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 and not false %}c{% else %}{{ x }}{% endif %}{{ 1 + 1 }}"))
    assert tree == ("block", [("text", "aBc2")])


def test_generation_marks():
    assert render("a{% generation %}{{ x }}{% endgeneration %}b", x="y") == [("a", False), ("y", True), ("b", False)]


@pytest.mark.parametrize("bad", ["{{ x", "{% for %}", "{% endif %}", "{% if a %}", "{{ x.__class__ }}", "{{ _x }}", "{{ x | run }}", "{{ open('f') }}", "{% import os %}", "{{ 'a' 'b' }}", "{% generation %}", "{{ (" + "(" * 99 + "1" + ")" * 100 + " }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        text(bad, x="y", a=1)


CHAINS = ["{{ " + "not " * 5000 + "a }}", "{{ " + "a + " * 5000 + "a }}", "{{ a" + ".b" * 5000 + " }}", "{{ a" + " | trim" * 5000 + " }}", "{{ " + "a or " * 5000 + "a }}", "{{ a == " + "9" * 5000 + " }}"]
LARGE = [
    "{% set a = 'abcdefgh' %}" + "{% set a = a ~ a %}" * 30 + "{{ a }}",
    "{% set a = x %}" + "{% set a = a + a %}" * 30 + "{{ a }}",
    "{{ '#'" + " | escape" * 40 + " }}",
    "{% set a = '#' %}" + "{% set a = a | escape %}" * 40 + "{{ a }}",
    "{% set a = 999999999999999999 %}" + "{% set a = a + a %}" * 99,
]
KINDS = ["{% for i in 5 %}{% endfor %}", "{% for i in none %}{% endfor %}", "{% for i in 'abc' %}{% endfor %}", "{{ m[m] }}", "{{ m[none] }}"]


@pytest.mark.parametrize("bad", [*CHAINS, *LARGE, *KINDS])
def test_limits_are_template_errors(monkeypatch, bad):
    monkeypatch.setattr(chat, "MAX_VALUE", 1 << 16)
    with pytest.raises(chat.TemplateError):
        text(bad, x="y", a=1, m={"k": 1})


def test_given_texts_may_be_long(monkeypatch):
    monkeypatch.setattr(chat, "MAX_VALUE", 1 << 16)
    long = "#" * (chat.MAX_VALUE + 1)
    assert len(text("{% for m in ms %}{{ m.text | escape }}{% endfor %}", ms=[{"text": long}])) == 2 * len(long)


def test_only_mappings_have_keys():
    with pytest.raises(chat.TemplateError):
        text("{{ x.upper }}", x="y")
    with pytest.raises(chat.TemplateError):
        text("{{ nothing }}")


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_round_trip(spark, part):
    hard = ["\\### Assistant: </turn> ok", "", None, "\\", "###", "</turn>\n### user: x</turn>\n", "a:b\\:c", "é\n\n", "x" * 5000]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", h) for h in hard] + [("assistant", h) for h in hard] + [("we:ird\n#", "z"), (None, "n")])]
    rows += [(1, 3, "user", "tie"), (1, None, "system", "first"), (5, 0, "assistant", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "c")
    from pyspark.sql import functions as F

    turns = turns.select(F.col("c").alias("conv_id"), "turn", "role", "text", F.lit(1).alias("part"), F.lit("x").alias("formatted"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns, part_chars=part)).collect()}
    assert set(got) == {1, 2, None, 5}
    for c, r in got.items():
        own = sorted(((-1 if t is None else t, role or "", x or "") for cc, t, role, x in rows if cc == c))
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(14 + len(chat.escape_role(role)) + len(chat.escape(x)) for _, role, x in own)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
