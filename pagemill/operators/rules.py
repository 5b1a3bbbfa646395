"""Requirements by declarative rules, and the validation of workflow state against them.

A rule has an id, conditions by field (any of the values; ``traits_any`` meets, ``traits_all`` is contained)
and what it requires. A rule table is small by contract (``MAX_RULES``, checked), so it is sent to every task, as bit sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as tx
from . import ordered
from .ledger import violations
from .rule_index import RuleIndex
from .settle import settled

MAX_RULES = 10_000
FIELDS = ("operation", "source_kind", "delivery_level", "execution_mode", "verification_scope", "outcome")

# The vocabulary of contexts and records, exit codes and ranks.
VALUES = {
    "operation": ("convert", "resume", "refine", "repair", "review"),
    "source_kind": ("digital", "scanned", "mixed", "unknown"),
    "traits": ("book", "long-document", "math-heavy", "encoded-math", "cjk", "visual-complex"),
    "delivery_level": ("rough-draft", "clean-semantic", "publication-polish"),
    "execution_mode": ("one-turn", "resumable", "goal-backed"),
    "verification_scope": ("source-aware", "project-only"),
    "outcome": ("complete", "blocked", "downgraded", "in-progress"),
}
RECORD_STATUSES = ("pending", "in-progress", "rebuilt", "reviewed", "blocked", "omitted-with-reason")
COMPLETE_STATUSES = ("rebuilt", "reviewed", "omitted-with-reason")
COMPILE_CHECKS = ("not-run", "pass", "fail")
VISUAL_REVIEWS = ("not-run", "pass", "fail", "not-applicable")
SOURCE_FIDELITY = ("in-progress", "verified", "not-verified-source-unavailable", "not-verified-by-scope")
FINAL_OUTCOMES = ("complete", "downgraded")
EXIT_CODES = {"complete": 0, "downgraded": 0, "in-progress": 1, "blocked": 2, "invalid": 1}
DELIVERY_RANK = {"rough-draft": 0, "clean-semantic": 1, "publication-polish": 2}

# Fixed values: (id, conditions, required) in order.
FILE_RULES = (
    ("all-projects", {}, ("main.tex",)),
    ("stateful-workflow", {"operation": ("convert", "resume", "refine")}, ("conversion-state.md", "conversion-notes.md")),
    ("durable-repair-workflow", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed")}, ("conversion-state.md", "conversion-notes.md")),
    ("publication-repair-workflow", {"operation": ("repair",), "delivery_level": ("publication-polish",)}, ("conversion-state.md", "conversion-notes.md")),
    ("full-reconstruction-model", {"operation": ("convert", "resume")}, ("page-manifest.md", "object-inventory.md", "style-profile.md", "document-ir.md")),
    ("refinement-style-model", {"operation": ("refine",)}, ("style-profile.md",)),
    ("publication-refinement-model", {"operation": ("refine",), "delivery_level": ("publication-polish",)}, ("page-manifest.md", "object-inventory.md", "document-ir.md")),
    ("publication-repair-style", {"operation": ("repair",), "delivery_level": ("publication-polish",)}, ("style-profile.md",)),
    ("visual-source-model", {"operation": ("convert", "resume", "refine"), "source_kind": ("scanned", "mixed")}, ("page-manifest.md", "object-inventory.md", "document-ir.md")),
    ("book-model", {"operation": ("convert", "resume", "refine"), "traits_any": ("book",)}, ("page-manifest.md", "object-inventory.md", "style-profile.md", "document-ir.md")),
    ("long-document-model", {"operation": ("convert", "resume", "refine"), "traits_any": ("long-document",)}, ("page-manifest.md", "document-ir.md")),
    ("math-model", {"operation": ("convert", "resume", "refine"), "traits_any": ("math-heavy", "encoded-math")}, ("object-inventory.md", "math-inventory.md", "glyph-map.md")),
    ("durable-math-repair-model", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed"), "traits_any": ("math-heavy", "encoded-math")}, ("object-inventory.md", "math-inventory.md", "glyph-map.md")),
    ("publication-math-repair-model", {"operation": ("repair",), "delivery_level": ("publication-polish",), "traits_any": ("math-heavy", "encoded-math")}, ("object-inventory.md", "math-inventory.md", "glyph-map.md")),
    ("cjk-style-model", {"operation": ("convert", "resume", "refine"), "traits_any": ("cjk",)}, ("style-profile.md",)),
    ("durable-cjk-repair-model", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed"), "traits_any": ("cjk",)}, ("style-profile.md",)),
    ("publication-cjk-repair-model", {"operation": ("repair",), "delivery_level": ("publication-polish",), "traits_any": ("cjk",)}, ("style-profile.md",)),
    ("visual-complex-model", {"operation": ("convert", "resume", "refine"), "traits_any": ("visual-complex",)}, ("page-manifest.md", "object-inventory.md", "style-profile.md")),
)
GATE_RULES = (
    ("stateful-base", {"operation": ("convert", "resume", "refine")}, ("workflow-setup", "build-verification", "final-state-review")),
    ("durable-repair-base", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed")}, ("workflow-setup", "build-verification", "final-state-review")),
    ("convert-gates", {"operation": ("convert",)}, ("source-analysis", "semantic-reconstruction")),
    ("resume-gates", {"operation": ("resume",)}, ("resume-integrity", "semantic-reconstruction")),
    ("refine-gates", {"operation": ("refine",)}, ("refinement-review",)),
    ("repair-gates", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed")}, ("repair-verification",)),
    ("source-aware-gates", {"operation": ("convert", "resume", "refine", "review"), "verification_scope": ("source-aware",)}, ("source-fidelity-review",)),
    ("durable-source-aware-repair-gates", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed"), "verification_scope": ("source-aware",)}, ("source-fidelity-review",)),
    ("publication-source-aware-repair-gates", {"operation": ("repair",), "delivery_level": ("publication-polish",), "verification_scope": ("source-aware",)}, ("source-fidelity-review",)),
    ("publication-gates", {"operation": ("convert", "resume", "refine", "review"), "delivery_level": ("publication-polish",)}, ("artifact-scan", "clean-room-build", "publication-review")),
    ("publication-repair-gates", {"operation": ("repair",), "delivery_level": ("publication-polish",)}, ("workflow-setup", "build-verification", "final-state-review", "repair-verification", "artifact-scan", "clean-room-build", "publication-review")),
    ("book-gates", {"operation": ("convert", "resume", "refine", "review"), "traits_any": ("book",)}, ("book-structure-review",)),
    ("math-gates", {"operation": ("convert", "resume", "refine", "review"), "traits_any": ("math-heavy", "encoded-math")}, ("math-object-review",)),
    ("durable-math-repair-gates", {"operation": ("repair",), "execution_mode": ("resumable", "goal-backed"), "traits_any": ("math-heavy", "encoded-math")}, ("math-object-review",)),
    ("publication-math-repair-gates", {"operation": ("repair",), "delivery_level": ("publication-polish",), "traits_any": ("math-heavy", "encoded-math")}, ("math-object-review",)),
)

CONDITIONS = (*FIELDS[:5], "traits_any", "traits_all")
RULE_SCHEMA = "rule_no int, rule_id string, " + ", ".join(f"{c} array<string>" for c in CONDITIONS) + ", required array<string>"


def rule_table(spark: SparkSession, rules=FILE_RULES) -> DataFrame:
    """Rules as rows; no condition is null. A table of rules read from a contract has the same columns."""
    rows = []
    for no, (name, when, required) in enumerate(rules):
        if unknown := set(when) - set(CONDITIONS):
            raise ValueError(f"rule {name!r} has unknown conditions {sorted(unknown)}")
        rows.append((no, name, *[list(when[c]) if c in when else None for c in CONDITIONS], list(required)))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_violations(rules: DataFrame) -> DataFrame:
    """Rules that repeat an id, require nothing, or name values that don't exist."""
    bad = {f: (F.size(F.array_except(f, F.array(*map(F.lit, VALUES[f])))) > 0, F.array_join(f, ",")) for f in FIELDS[:5]}
    bad |= {f: (F.size(F.array_except(f, F.array(*map(F.lit, VALUES["traits"])))) > 0, F.array_join(f, ",")) for f in ("traits_any", "traits_all")}
    bad |= {"nothing-required": (F.size("required") == 0, F.lit(""))}
    own = violations(rules, "rule", F.col("rule_id"), bad)
    twice = rules.groupBy("rule_id").count().where("count > 1").select(F.lit("rule").alias("entity"), F.col("rule_id").alias("entity_key"), F.lit("repeated-id").alias("rule_id"), F.col("count").cast("string").alias("detail"))
    return own.unionByName(twice)


def ordered_differences(actual: DataFrame, expected: DataFrame, keys: list[str], item: str, place: str, values: list[str], chunk: int = ordered.CHUNK) -> DataFrame:
    """``keys, item, problem, expected_place, actual_place``: how two ordered tables differ.

    Problems are ``missing`` and ``unexpected`` items, ``changed:`` and the fields whose values differ (nulls are values), and ``moved``:
    an item that isn't at its place among the items that both have, so that a missing one moves no other. Items are unique within a key,
    and so are places. Both sides are of any size; one key may hold most rows.
    """
    sides = {"a": actual, "e": expected}
    names = {s: [F.col(k) for k in [*keys, item]] + [F.col(place).alias(f"__{s}_place"), F.struct(*values, F.lit(1).alias("__one")).alias(f"__{s}")] for s in sides}
    a, e = (df.select(*names[s]) for s, df in sides.items())
    both = settled(a.join(e, [*keys, item], "full_outer"))
    common = both.where("__a IS NOT NULL AND __e IS NOT NULL").select(*keys, item, "__a_place", "__e_place")
    ranked = ordered.ordinal(ordered.with_chunk(common, keys, ["__a_place"], chunk, ready=True), keys, ["__a_place"], "__a_rank").drop("__chunk")
    ranked = ordered.ordinal(ordered.with_chunk(ranked, keys, ["__e_place"], chunk), keys, ["__e_place"], "__e_rank").drop("__chunk")
    moved = ranked.where("__a_rank <> __e_rank").select(*keys, item, F.lit("moved").alias("problem"), F.col("__e_place").alias("expected_place"), F.col("__a_place").alias("actual_place"))
    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.col("__a")[v].eqNullSafe(F.col("__e")[v]), F.lit(v)) for v in values])), ",")
    problem = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(differ != "", F.concat(F.lit("changed:"), differ))
    own = both.select(*keys, item, problem.alias("problem"), F.col("__e_place").alias("expected_place"), F.col("__a_place").alias("actual_place")).where("problem IS NOT NULL")
    return own.unionByName(moved)


def contract_differences(contract: DataFrame, expected: DataFrame) -> DataFrame:
    """How a rule table differs from the one it should be: rules missing, unexpected, changed or moved."""
    one = F.lit(0).alias("contract")
    return ordered_differences(contract.select(one, "*"), expected.select(one, "*"), ["contract"], "rule_id", "rule_no", [*CONDITIONS, "required"]).drop("contract")


def _bounded(rules: DataFrame) -> list[Row]:
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    return rows


def matching_rules(contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Contexts with each rule that they meet (its columns begin with ``__``).

    The rules, a bounded number, become bit sets by field value, which the tasks intersect; a context's rules are then joined by their numbers.
    """
    rows = _bounded(rules)
    spark, n = contexts.sparkSession, contexts.columns
    index = RuleIndex(rows, FIELDS[:5]) if rows else None

    def run(batches):
        for batch in batches:
            for part, found in index.matching(batch) if index else ():
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*n, "__met"])

    schema = StructType([*contexts.schema.fields, StructField("__met", ArrayType(IntegerType()))])
    met = contexts.mapInArrow(run, schema).select(*n, F.explode("__met").alias("__at"))
    numbered = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], StructType([StructField("__no", IntegerType()), *rules.schema.fields]))
    numbered = numbered.select("__no", *[F.col(c).alias(f"__{c}") for c in rules.columns])
    return met.join(F.broadcast(numbered), F.col("__at") == F.col("__no")).drop("__at", "__no")


def _first_places(contexts: DataFrame, rules: DataFrame, key: str, name: str) -> DataFrame:
    """``key, name, place``: what each row's rules require, each once, with the first place; no row is looked at with others."""
    rows = _bounded(rules)
    asked = sorted((r["rule_no"], i, no, x) for no, r in enumerate(rows) for i, x in enumerate(r["required"] or ()))
    places = pa.array([{"rule_no": r, "item_no": i} for r, i, _, _ in asked], pa.struct([("rule_no", pa.int32()), ("item_no", pa.int32())]))
    kinds = {x: k for k, x in enumerate(dict.fromkeys(x for *_, x in asked))}
    names, kind = pa.array(list(kinds), pa.string()), np.array([kinds[x] for *_, x in asked], np.int64)
    of_rule = [[] for _ in rows]
    for e, (_, _, no, _) in enumerate(asked):
        of_rule[no].append(e)
    of_rule = [np.array(e, np.int64) for e in of_rule]
    size = np.array([len(e) for e in of_rule], np.int64)
    index = RuleIndex(rows, FIELDS[:5]) if rows else None

    def run(batches):
        for batch in batches:
            for part, found in index.matching(batch) if asked else ():
                rule = found.values.to_numpy()
                if not len(rule):
                    continue
                row = np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy()))
                entry = np.concatenate([of_rule[r] for r in rule])
                # entries are numbered by their places, so the least one of a row and name is the first
                pair = np.repeat(row, size[rule]) * len(names) + kind[entry]
                order = np.lexsort((entry, pair))
                first = order[np.flatnonzero(np.diff(pair[order], prepend=-1))]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(pair[first] // len(names))), names.take(pa.array(kind[entry[first]])), places.take(pa.array(entry[first]))], [key, name, "place"])

    place = StructType([StructField("rule_no", IntegerType()), StructField("item_no", IntegerType())])
    return contexts.mapInArrow(run, StructType([contexts.schema[key], StructField(name, StringType()), StructField("place", place)]))


def requirements(contexts: DataFrame, rules: DataFrame, key: str = "context_id", name: str = "required") -> DataFrame:
    """What each context's rules require, each once, with its place (the first rule that asks for it, and where there).

    A context is mostly one row, whose requirements need no other row; only those of contexts with several rows are grouped.
    """
    keyed = contexts.withColumn("__rows", F.count("*").over(Window.partitionBy(key)))
    one, several = (_first_places(keyed.where(test).drop("__rows"), rules, key, name) for test in ("__rows = 1", "__rows > 1"))
    return one.unionByName(several.groupBy(key, name).agg(F.min("place").alias("place")))


def requirement_lists(contexts: DataFrame, rules: DataFrame, key: str = "context_id") -> DataFrame:
    """The same as one ordered array for each context (there are at most as many items as the rules name)."""
    rows = requirements(contexts, rules, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "required"))).alias("r"))
    return contexts.select(key).join(rows, key, "left").select(key, F.coalesce(F.transform("r", lambda x: x["required"]), F.array().cast("array<string>")).alias("required"))


def canonical_traits(traits: Column) -> Column:
    """Traits in the vocabulary's order, each once."""
    return F.array_compact(F.array(*[F.when(F.array_contains(traits, t), F.lit(t)) for t in VALUES["traits"]]))


def normalise_context(contexts: DataFrame) -> DataFrame:
    out = contexts
    for f in FIELDS:
        out = out.withColumn(f, F.trim(f))
    return out.withColumn("traits_text", F.when(F.size("traits") == 0, "none").otherwise(F.array_join(canonical_traits(F.col("traits")), ", ")))


def context_rules() -> dict[str, tuple[Column, Column]]:
    """Every test of a context by itself; true where it is broken."""
    c = F.col
    final, aware = c("outcome").isin(*FINAL_OUTCOMES), c("verification_scope") == "source-aware"
    down = c("outcome") == "downgraded"
    rank = lambda x: F.element_at(F.create_map(*[y for k, v in DELIVERY_RANK.items() for y in (F.lit(k), F.lit(v))]), x)
    known_level = c("previous_delivery").isin(*VALUES["delivery_level"])
    passed = c("visual_review") == "pass"

    def unless(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    rules = {f"unknown-{f.replace('_', '-')}": (unless(c(f).isin(*VALUES[f])), c(f)) for f in FIELDS}
    rules["unknown-trait"] = (F.size(F.array_except("traits", F.array(*map(F.lit, VALUES["traits"])))) > 0, F.array_join("traits", ","))
    rules["repeated-trait"] = (F.size(F.array_distinct("traits")) < F.size("traits"), F.array_join("traits", ","))
    rules |= {
        "convert-needs-source": ((c("operation") == "convert") & ~aware, c("verification_scope")),
        "final-needs-source-kind": (final & aware & (c("source_kind") == "unknown"), c("source_kind")),
        "unknown-compile-check": (unless(c("compile_check").isin(*COMPILE_CHECKS)), c("compile_check")),
        "unknown-visual-review": (unless(c("visual_review").isin(*VISUAL_REVIEWS)), c("visual_review")),
        "unknown-source-fidelity": (unless(c("source_fidelity").isin(*SOURCE_FIDELITY)), c("source_fidelity")),
        "next-action-not-concrete": (~tx.is_concrete(c("next_action")), c("next_action")),
        "final-needs-compile-pass": (final & unless(c("compile_check") == "pass"), c("compile_check")),
        "polish-needs-visual-pass": (final & (c("delivery_level") == "publication-polish") & unless(passed), c("visual_review")),
        "clean-needs-visual-pass": (final & (c("delivery_level") == "clean-semantic") & (c("operation") != "repair") & unless(passed), c("visual_review")),
        "source-aware-needs-visual-pass": (final & aware & unless(passed), c("visual_review")),
        "source-aware-needs-verified": (final & aware & unless(c("source_fidelity") == "verified"), c("source_fidelity")),
        "project-only-visual-review": (final & ~aware & unless(c("visual_review").isin("pass", "not-applicable")), c("visual_review")),
        "project-only-fidelity": (final & ~aware & unless(c("source_fidelity").isin("not-verified-source-unavailable", "not-verified-by-scope")), c("source_fidelity")),
        "downgrade-needs-level": (down & unless(known_level), c("previous_delivery")),
        "downgrade-not-lower": (down & F.when(known_level, rank(c("previous_delivery")) <= rank(c("delivery_level"))).otherwise(False), c("previous_delivery")),
        "downgrade-needs-approval": (down & ~tx.is_concrete(c("downgrade_approval")), c("downgrade_approval")),
    }
    return rules


def context_violations(contexts: DataFrame, key: str = "context_id") -> DataFrame:
    return violations(contexts, "context", F.col(key), context_rules())


def gate_violations(contexts: DataFrame, recorded: DataFrame, rules: DataFrame, key: str = "context_id", unexpected: bool = False) -> DataFrame:
    """Required gates that are missing or not reviewed (where the outcome is final), repeated gates and, if asked, unexpected ones.

    ``recorded`` has ``key, gate, status``.
    """
    needed = requirements(contexts, rules, key, "gate").select(key, "gate")
    final = contexts.select(key, F.col("outcome").isin(*FINAL_OUTCOMES).alias("__final"))
    seen = recorded.groupBy(key, "gate").agg(F.count("*").alias("__n"), F.min("status").alias("__status"))

    def rows(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.lit("gate").alias("entity"), F.col(key).cast("string").alias("entity_key"), F.lit(rule).alias("rule_id"), F.col("gate").alias("detail"))

    both = needed.join(seen, [key, "gate"], "left").join(final, key)
    parts = [
        rows(both.where("__n is null"), "missing-gate"),
        rows(both.where("__final and __n is not null and coalesce(__status, '') <> 'reviewed'"), "gate-not-reviewed"),
        rows(seen.where("__n > 1"), "repeated-gate"),
    ]
    if unexpected:
        parts.append(rows(seen.join(needed, [key, "gate"], "left_anti"), "unexpected-gate"))
    return reduce(DataFrame.unionByName, parts)


def file_violations(contexts: DataFrame, present: DataFrame, rules: DataFrame, key: str = "context_id") -> DataFrame:
    """Required files that aren't there; ``present`` has ``key, file``."""
    needed = requirements(contexts, rules, key, "file").select(key, "file")
    gone = needed.join(present.select(key, "file"), [key, "file"], "left_anti")
    return gone.select(F.lit("file").alias("entity"), F.col(key).cast("string").alias("entity_key"), F.lit("missing-file").alias("rule_id"), F.col("file").alias("detail"))


def record_violations(records: DataFrame, key: Column, require_status: bool = True) -> DataFrame:
    """Lifecycle records (status, reason, next_action, compile_check, visual_review; null where a field is absent)."""
    c = F.col
    known = c("status").isin(*RECORD_STATUSES)
    rules = {
        "missing-status": (c("status").isNull() & F.lit(require_status), F.lit("")),
        "unknown-status": (c("status").isNotNull() & ~known, c("status")),
        "blocked-without-reason": ((c("status") == "blocked") & ~tx.is_concrete(c("reason")), F.lit("")),
        "blocked-without-next-action": ((c("status") == "blocked") & ~tx.is_concrete(c("next_action")), F.lit("")),
        "omitted-without-reason": ((c("status") == "omitted-with-reason") & ~tx.is_concrete(c("reason")), F.lit("")),
        "unknown-compile-check": (known & ~c("compile_check").isin(*COMPILE_CHECKS), c("compile_check")),
        "unknown-visual-review": (known & ~c("visual_review").isin(*VISUAL_REVIEWS), c("visual_review")),
    }
    return violations(records, "record", key, rules)


def lifecycle_violations(contexts: DataFrame, records: DataFrame, key: str = "context_id") -> DataFrame:
    """A blocked outcome needs a blocked record; a final one may have none that is open."""
    open_record = F.col("status").isNotNull() & ~F.col("status").isin(*COMPLETE_STATUSES)
    per = records.groupBy(key).agg(F.bool_or(F.col("status") == "blocked").alias("__blocked"), F.count_if(open_record).alias("__open"))
    both = contexts.select(key, "outcome").join(per, key, "left")
    return violations(both, "context", F.col(key), {
        "blocked-needs-record": ((F.col("outcome") == "blocked") & ~F.coalesce("__blocked", F.lit(False)), F.lit("")),
        "final-with-open-records": (F.col("outcome").isin(*FINAL_OUTCOMES) & (F.coalesce("__open", F.lit(0)) > 0), F.col("__open")),
    })


def unblocked_gates(gates: DataFrame, blockers: DataFrame, on: list[str]) -> DataFrame:
    """Blocked gates that no blocker record explains."""
    return gates.where("status = 'blocked'").join(blockers, on, "left_anti")


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields in which two rows of a key differ (nulls are values)."""
    both = a.alias("a").join(b.alias("b"), key)
    found = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("left_value"), F.col(f"b.{f}").cast("string").alias("right_value"))) for f in fields]))
    return both.select(key, F.explode(found).alias("d")).select(key, "d.*")


def outcomes(contexts: DataFrame, broken: DataFrame, key: str = "context_id") -> DataFrame:
    """Violations and exit code of each context: any violation is invalid, else the outcome's code."""
    n = broken.groupBy(F.col("entity_key")).agg(F.count("*").alias("violations"))
    both = contexts.select(key, "outcome").join(n, F.col(key).cast("string") == F.col("entity_key"), "left").withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
    code = F.element_at(F.create_map(*[y for k, v in EXIT_CODES.items() for y in (F.lit(k), F.lit(v))]), F.when(F.col("violations") > 0, "invalid").otherwise(F.col("outcome")))
    return both.select(key, "outcome", "violations", code.alias("exit_code"))


def tool_capability(hosts: DataFrame) -> DataFrame:
    """What hosts ``host, tools array<string>`` can do."""
    have = lambda *names: reduce(lambda a, b: a & b, [F.array_contains("tools", n) for n in names])
    yes = lambda test: F.when(test, "available").otherwise("unavailable")
    bibliography = F.array_compact(F.array(*[F.when(have(n), F.lit(n)) for n in ("biber", "bibtex")]))
    return hosts.select(
        "host", F.when(have("latexmk", "xelatex"), "full").when(have("xelatex"), "simple-only").otherwise("unavailable").alias("compile"),
        F.when(have("pdftoppm"), "pdftoppm").when(have("mutool"), "mutool").otherwise("unavailable").alias("render"),
        yes(have("pdftotext")).alias("text_layer"), yes(have("pdfinfo")).alias("pdf_metadata"), yes(have("pdfseparate")).alias("single_page"),
        F.when(F.size(bibliography) == 0, F.array(F.lit("unavailable"))).otherwise(bibliography).alias("bibliography"),
        yes(have("makeindex")).alias("index"), yes(have("makeglossaries")).alias("glossary"),
    )


def capability_failures(capability: DataFrame, level: str) -> DataFrame:
    """What hosts lack for ``none``, ``core`` or ``publication``."""
    if level not in ("none", "core", "publication"):
        raise ValueError(f"unknown level {level!r}")
    core, full = level in ("core", "publication"), level == "publication"
    lacks = F.array_compact(F.array(
        F.when(F.lit(core) & (F.col("compile") == "unavailable"), "XeLaTeX"), F.when(F.lit(core) & (F.col("pdf_metadata") == "unavailable"), "pdfinfo"),
        F.when(F.lit(core) & (F.col("render") == "unavailable"), "pdftoppm or mutool"), F.when(F.lit(full) & (F.col("compile") != "full"), "latexmk + XeLaTeX"),
        F.when(F.lit(full) & (F.col("text_layer") == "unavailable"), "pdftotext"),
    ))
    return capability.select("host", lacks.alias("failures"))
