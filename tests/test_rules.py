import itertools

import pytest
from pyspark.sql import functions as F

from pagemill.operators import rules


def expected(context, table):
    """Rules in plain Python."""
    out = []
    for _, when, required in table:
        ok = all((set(v) & set(context["traits"])) if k == "traits_any" else set(v) <= set(context["traits"]) if k == "traits_all" else context[k] in v for k, v in when.items())
        out += [r for r in required if ok and r not in out]
    return out


def test_every_context(spark):
    """All 23,040 combinations, against plain Python."""
    traits = [[t for i, t in enumerate(rules.VALUES["traits"]) if n >> i & 1] for n in range(64)]
    names = ("operation", "source_kind", "delivery_level", "execution_mode", "verification_scope", "traits")
    combos = list(itertools.product(*[rules.VALUES[n] for n in names[:5]], traits))
    assert len(combos) == 23040
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(combos)], "context_id int, operation string, source_kind string, delivery_level string, execution_mode string, verification_scope string, traits array<string>")
    for table in (rules.FILE_RULES, rules.GATE_RULES):
        got = {r["context_id"]: r["required"] for r in rules.requirement_lists(df, rules.rule_table(spark, table)).collect()}
        for i, c in enumerate(combos):
            assert got[i] == expected(dict(zip(names, c, strict=True)), table)


def test_rule_tables_are_sound(spark):
    for table in (rules.FILE_RULES, rules.GATE_RULES):
        assert rules.rule_violations(rules.rule_table(spark, table)).count() == 0
    bad = rules.rule_table(spark, (("a", {"operation": ("fly",)}, ("x",)), ("a", {}, ()), ("t", {"traits_all": ("odd",)}, ("y",))))
    assert sorted(r["rule_id"] for r in rules.rule_violations(bad).collect()) == ["nothing-required", "operation", "repeated-id", "traits_all"]
    with pytest.raises(ValueError):
        rules.rule_table(spark, (("a", {"colour": ("red",)}, ("x",)),))


GOOD = {"context_id": 1, "operation": "convert", "source_kind": "digital", "traits": [], "delivery_level": "clean-semantic", "execution_mode": "one-turn", "verification_scope": "source-aware", "outcome": "complete", "compile_check": "pass", "visual_review": "pass", "source_fidelity": "verified", "next_action": "none left", "previous_delivery": "", "downgrade_approval": ""}
SCHEMA = "context_id int, operation string, source_kind string, traits array<string>, " + ", ".join(f"{c} string" for c in list(GOOD)[4:])


@pytest.mark.parametrize(("change", "rule"), [
    ({}, None), ({"outcome": "blocked"}, None), ({"outcome": "in-progress", "compile_check": "not-run"}, None), ({"operation": "fly"}, "unknown-operation"), ({"traits": ["cjk", "cjk"]}, "repeated-trait"), ({"traits": ["odd"]}, "unknown-trait"),
    ({"verification_scope": "project-only", "source_fidelity": "not-verified-by-scope"}, "convert-needs-source"), ({"source_kind": "unknown"}, "final-needs-source-kind"), ({"compile_check": "fail"}, "final-needs-compile-pass"), ({"compile_check": None}, "unknown-compile-check"),
    ({"visual_review": "fail"}, "source-aware-needs-visual-pass"), ({"source_fidelity": "in-progress"}, "source-aware-needs-verified"), ({"next_action": " "}, "next-action-not-concrete"), ({"next_action": "{{NEXT}}"}, "next-action-not-concrete"),
    ({"outcome": "downgraded", "previous_delivery": "publication-polish", "downgrade_approval": "yes"}, None), ({"outcome": "downgraded", "downgrade_approval": "yes"}, "downgrade-needs-level"),
    ({"outcome": "downgraded", "previous_delivery": "clean-semantic", "downgrade_approval": "yes"}, "downgrade-not-lower"), ({"outcome": "downgraded", "previous_delivery": "publication-polish"}, "downgrade-needs-approval"),
    ({"operation": "repair", "verification_scope": "project-only", "visual_review": "not-applicable", "source_fidelity": "not-verified-by-scope"}, None), ({"operation": "repair", "verification_scope": "project-only", "visual_review": "not-applicable"}, "project-only-fidelity"),
])
def test_contexts(spark, change, rule):
    df = spark.createDataFrame([tuple({**GOOD, **change}.values())], SCHEMA)
    found = {r["rule_id"] for r in rules.context_violations(df).collect()}
    assert found == set() if rule is None else rule in found


def test_gates_records_and_exit_codes(spark):
    contexts = spark.createDataFrame([tuple({**GOOD, "context_id": i, "outcome": o}.values()) for i, o in ((1, "complete"), (2, "blocked"), (3, "in-progress"), (4, "downgraded"))], SCHEMA)
    table = rules.rule_table(spark, rules.GATE_RULES)
    need = [r["gate"] for r in rules.requirements(contexts.where("context_id = 1"), table, name="gate").collect()]
    gates = spark.createDataFrame([(i, g, "reviewed" if (i, g) != (4, need[0]) else "pending") for i in (1, 2, 3, 4) for g in need if (i, g) != (3, need[0])] + [(1, "more", "reviewed"), (2, need[0], "reviewed")], "context_id int, gate string, status string")
    found = sorted((r["entity_key"], r["rule_id"]) for r in rules.gate_violations(contexts, gates, table, unexpected=True).collect())
    assert found == [("1", "unexpected-gate"), ("2", "repeated-gate"), ("3", "missing-gate"), ("4", "gate-not-reviewed")]
    records = spark.createDataFrame([(1, "reviewed", None, None, None, None), (2, "pending", "r", "n", "pass", "pass"), (4, "blocked", " ", "n", None, None)], "context_id int, status string, reason string, next_action string, compile_check string, visual_review string")
    broken = rules.lifecycle_violations(contexts, records).unionByName(rules.record_violations(records, F.col("context_id")))
    assert sorted((r["entity_key"], r["rule_id"]) for r in broken.collect()) == [("2", "blocked-needs-record"), ("4", "blocked-without-reason"), ("4", "final-with-open-records")]
    codes = {r["context_id"]: r["exit_code"] for r in rules.outcomes(contexts, broken.where("entity_key <> '2'")).collect()}
    assert codes == {1: 0, 2: 2, 3: 1, 4: 1}


def test_files_and_fields(spark):
    contexts = spark.createDataFrame([tuple(GOOD.values())], SCHEMA)
    present = spark.createDataFrame([(1, "main.tex")], "context_id int, file string")
    gone = [r["detail"] for r in rules.file_violations(contexts, present, rules.rule_table(spark)).collect()]
    assert sorted(gone) == ["conversion-notes.md", "conversion-state.md", "document-ir.md", "object-inventory.md", "page-manifest.md", "style-profile.md"]
    other = contexts.withColumn("outcome", F.lit(None).cast("string"))
    assert [tuple(r) for r in rules.field_differences(contexts, other, "context_id", ["operation", "outcome"]).collect()] == [(1, "outcome", "complete", None)]
    spaced = contexts.withColumn("operation", F.lit(" convert ")).withColumn("traits", F.array(F.lit("cjk"), F.lit("book")))
    r = rules.normalise_context(spaced).first()
    assert (r["operation"], r["traits_text"]) == ("convert", "book, cjk")
    blocked = spark.createDataFrame([("g", "blocked"), ("h", "reviewed")], "gate string, status string")
    assert rules.unblocked_gates(blocked, spark.createDataFrame([("x",)], "gate string"), ["gate"]).first()["gate"] == "g"


def test_hosts(spark):
    hosts = spark.createDataFrame([("a", ["latexmk", "xelatex", "pdfinfo", "mutool", "pdftotext", "biber"]), ("b", ["xelatex"]), ("c", [])], "host string, tools array<string>")
    cap = rules.tool_capability(hosts)
    assert {r["host"]: (r["compile"], r["render"], r["bibliography"]) for r in cap.collect()} == {"a": ("full", "mutool", ["biber"]), "b": ("simple-only", "unavailable", ["unavailable"]), "c": ("unavailable", "unavailable", ["unavailable"])}
    lacks = lambda level: {r["host"]: r["failures"] for r in rules.capability_failures(cap, level).collect()}
    assert lacks("publication")["a"] == [] and lacks("core")["b"] == ["pdfinfo", "pdftoppm or mutool"] and lacks("none")["c"] == []


def test_requirements_need_no_group_of_all_rows(spark):
    from pagemill.sources import tables

    contexts, table = tables.contexts(spark, "/root/testdata/sf0.001"), rules.rule_table(spark, rules.FILE_RULES)
    found = rules.requirements(contexts, table)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # every requirement of every rule as a row to be sorted
    once = sorted((r["context_id"], r["required"], tuple(r["place"])) for r in found.collect())
    assert once
    # contexts in several rows are one context; a null key is one too
    twice = contexts.unionByName(contexts).unionByName(contexts.limit(1).withColumn("context_id", F.lit(None).cast("long")))
    again = rules.requirements(twice, table).where("context_id is not null")
    assert sorted((r["context_id"], r["required"], tuple(r["place"])) for r in again.collect()) == once
    assert rules.requirements(contexts, table.limit(0)).collect() == []
