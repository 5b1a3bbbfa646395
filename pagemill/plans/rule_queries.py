"""Queries on rules, gates and outcomes, findings and dependencies, and extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, markdown, ordered, rules
from ..sources import tables
from ..streaming import ingest
from .page_queries import query


def _list(values) -> str:
    return "NULL::VARCHAR[]" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def rules_sql(table) -> str:
    rows = ", ".join(f"({no}, '{name}', " + ", ".join(_list(when.get(c)) for c in rules.CONDITIONS) + f", {_list(required)})" for no, (name, when, required) in enumerate(table))
    return f"(SELECT * FROM (VALUES {rows}) AS r(rule_no, rule_id, {', '.join('r_' + c for c in rules.CONDITIONS)}, required))"


def _pick(expr: str, *names: str) -> str:
    return f"list_extract({_list(names)}, (({expr}) % {len(names)} + 1)::INT)"


TRAITS_SQL = "list_filter([" + ", ".join(f"CASE WHEN (c_custkey // {2**i}) % 2 = 1 THEN '{t}' END" for i, t in enumerate(rules.VALUES["traits"])) + "], lambda x: x IS NOT NULL)"
CONTEXT_SQL = f"""(SELECT c_custkey AS context_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'convert' WHEN 'BUILDING' THEN 'resume' WHEN 'FURNITURE' THEN 'refine' WHEN 'HOUSEHOLD' THEN 'repair' ELSE 'review' END AS operation,
    {_pick('c_custkey', *rules.VALUES['source_kind'])} AS source_kind, {TRAITS_SQL} AS traits, {_pick('c_custkey // 3', *rules.VALUES['delivery_level'])} AS delivery_level,
    {_pick('c_custkey // 5', *rules.VALUES['execution_mode'])} AS execution_mode, {_pick('c_custkey // 7', *rules.VALUES['verification_scope'])} AS verification_scope, {_pick('c_custkey // 11', *rules.VALUES['outcome'])} AS outcome,
    {_pick('c_custkey // 13', 'pass', 'fail', 'not-run')} AS compile_check, {_pick('c_custkey // 17', 'pass', 'not-applicable', 'fail')} AS visual_review, {_pick('c_custkey // 19', 'verified', 'not-verified-by-scope', 'in-progress')} AS source_fidelity,
    {_pick('c_custkey // 23', 'go on', '', '{{NEXT}}')} AS next_action, {_pick('c_custkey // 29', 'publication-polish', 'clean-semantic', '')} AS previous_delivery, {_pick('c_custkey // 31', 'approved', '')} AS downgrade_approval
    FROM customer)"""


def required_sql(table, name: str) -> str:
    tests = [f"(r_{f} IS NULL OR list_contains(r_{f}, {f}))" for f in rules.CONDITIONS[:5]] + ["(r_traits_any IS NULL OR list_has_any(r_traits_any, traits))", "(r_traits_all IS NULL OR list_has_all(traits, r_traits_all))"]
    return f"SELECT context_id, {name}, min(rule_no) AS rule_no FROM (SELECT context_id, rule_no, unnest(required) AS {name} FROM {CONTEXT_SQL} c, {rules_sql(table)} r WHERE {' AND '.join(tests)}) GROUP BY context_id, {name}"


@query("required_files", required_sql(rules.FILE_RULES, "required"))
def q_files(spark: SparkSession, d: str) -> DataFrame:
    return rules.requirements(tables.contexts(spark, d), rules.rule_table(spark, rules.FILE_RULES)).select("context_id", "required", "place.rule_no")


@query("required_gates", required_sql(rules.GATE_RULES, "required"))
def q_gates(spark: SparkSession, d: str) -> DataFrame:
    return rules.requirements(tables.contexts(spark, d), rules.rule_table(spark, rules.GATE_RULES)).select("context_id", "required", "place.rule_no")


GATES = ("workflow-setup", "build-verification", "final-state-review", "source-fidelity-review", "artifact-scan", "extra-gate")
RECORDED_SQL = f"""(SELECT c_custkey AS context_id, gate, CASE WHEN (c_custkey + n) % 4 = 0 THEN 'pending' ELSE 'reviewed' END AS status
    FROM customer, (SELECT unnest({_list(GATES)}) AS gate, unnest(range(0, {len(GATES)})) AS n) WHERE (c_custkey + 2 * n) % 5 <> 0 UNION ALL SELECT c_custkey, 'artifact-scan', 'reviewed' FROM customer WHERE c_custkey % 9 = 0)"""


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """Gates that customers recorded: most of a fixed few, some not reviewed, some twice."""
    key = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("context_id"))
    rows = key.select("context_id", F.posexplode(F.array(*map(F.lit, GATES))).alias("n", "gate")).where("(context_id + 2 * n) % 5 <> 0")
    rows = rows.select("context_id", "gate", F.when((F.col("context_id") + F.col("n")) % 4 == 0, "pending").otherwise("reviewed").alias("status"))
    return rows.unionByName(key.where("context_id % 9 = 0").select("context_id", F.lit("artifact-scan").alias("gate"), F.lit("reviewed").alias("status")))


GATE_SQL = f"""
    WITH need AS ({required_sql(rules.GATE_RULES, 'gate')}), seen AS (SELECT context_id, gate, count(*) AS n, min(status) AS status FROM {RECORDED_SQL} GROUP BY ALL),
    both_ AS (SELECT need.context_id, need.gate, n, status, outcome IN ('complete', 'downgraded') AS final FROM need LEFT JOIN seen USING (context_id, gate) JOIN {CONTEXT_SQL} USING (context_id)),
    v AS (SELECT context_id, 'missing-gate' AS rule_id, gate FROM both_ WHERE n IS NULL UNION ALL SELECT context_id, 'gate-not-reviewed', gate FROM both_ WHERE final AND n IS NOT NULL AND status <> 'reviewed'
      UNION ALL SELECT context_id, 'repeated-gate', gate FROM seen WHERE n > 1 UNION ALL SELECT context_id, 'unexpected-gate', gate FROM seen ANTI JOIN need USING (context_id, gate))
"""


@query("gate_validation", GATE_SQL + "SELECT context_id::VARCHAR AS entity_key, rule_id, gate AS detail FROM v")
def q_gate_validation(spark: SparkSession, d: str) -> DataFrame:
    return rules.gate_violations(tables.contexts(spark, d), _recorded(spark, d), rules.rule_table(spark, rules.GATE_RULES), unexpected=True).drop("entity")


FINAL = "outcome IN ('complete', 'downgraded')"
AWARE = "verification_scope = 'source-aware'"
RANK = "CASE {} WHEN 'rough-draft' THEN 0 WHEN 'clean-semantic' THEN 1 WHEN 'publication-polish' THEN 2 END"
TESTS_SQL = {
    "convert-needs-source": f"operation = 'convert' AND NOT {AWARE}",
    "final-needs-source-kind": f"{FINAL} AND {AWARE} AND source_kind = 'unknown'",
    "next-action-not-concrete": "trim(next_action) = '' OR contains(next_action, '{{')",
    "final-needs-compile-pass": f"{FINAL} AND compile_check <> 'pass'",
    "polish-needs-visual-pass": f"{FINAL} AND delivery_level = 'publication-polish' AND visual_review <> 'pass'",
    "clean-needs-visual-pass": f"{FINAL} AND delivery_level = 'clean-semantic' AND operation <> 'repair' AND visual_review <> 'pass'",
    "source-aware-needs-visual-pass": f"{FINAL} AND {AWARE} AND visual_review <> 'pass'",
    "source-aware-needs-verified": f"{FINAL} AND {AWARE} AND source_fidelity <> 'verified'",
    "project-only-visual-review": f"{FINAL} AND NOT {AWARE} AND visual_review NOT IN ('pass', 'not-applicable')",
    "project-only-fidelity": f"{FINAL} AND NOT {AWARE} AND source_fidelity NOT IN ('not-verified-source-unavailable', 'not-verified-by-scope')",
    "downgrade-needs-level": "outcome = 'downgraded' AND previous_delivery = ''",
    "downgrade-not-lower": f"outcome = 'downgraded' AND previous_delivery <> '' AND {RANK.format('previous_delivery')} <= {RANK.format('delivery_level')}",
    "downgrade-needs-approval": "outcome = 'downgraded' AND downgrade_approval = ''",
}
CONTEXT_VIOLATIONS_SQL = f"SELECT context_id, unnest(list_filter([{', '.join(f'CASE WHEN {t} THEN {chr(39)}{n}{chr(39)} END' for n, t in TESTS_SQL.items())}], lambda x: x IS NOT NULL)) AS rule_id FROM {CONTEXT_SQL}"


@query("context_constraints", f"SELECT context_id::VARCHAR AS entity_key, rule_id FROM ({CONTEXT_VIOLATIONS_SQL})")
def q_constraints(spark: SparkSession, d: str) -> DataFrame:
    return rules.context_violations(tables.contexts(spark, d)).select("entity_key", "rule_id")


@query("workflow_outcome", GATE_SQL + f"""
    , a AS (SELECT context_id, count(*) AS violations FROM (SELECT context_id, rule_id FROM v WHERE rule_id <> 'unexpected-gate' UNION ALL {CONTEXT_VIOLATIONS_SQL}) GROUP BY context_id)
    SELECT context_id, outcome, coalesce(violations, 0) AS violations, CASE WHEN violations > 0 THEN 1 WHEN outcome = 'blocked' THEN 2 WHEN outcome = 'in-progress' THEN 1 ELSE 0 END AS exit_code FROM {CONTEXT_SQL} LEFT JOIN a USING (context_id)
""")  # fmt: skip
def q_outcome(spark: SparkSession, d: str) -> DataFrame:
    contexts = tables.contexts(spark, d)
    broken = rules.gate_violations(contexts, _recorded(spark, d), rules.rule_table(spark, rules.GATE_RULES)).unionByName(rules.context_violations(contexts))
    return rules.outcomes(contexts, broken)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as lifecycle records: a status, and fields of which some are blank or absent."""
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    key = F.col("o_orderkey")
    return tables.table(spark, d, "orders").select(
        key.alias("record_id"), pick(key, "blocked", "reviewed", "omitted-with-reason", "odd", "pending", None).alias("status"), pick(F.floor(key / 7), "because", " ", None, "{{REASON}}").alias("reason"),
        pick(F.floor(key / 3), "retry", "", None).alias("next_action"), pick(F.floor(key / 5), "pass", None, "maybe").alias("compile_check"), pick(F.floor(key / 11), None, "fail", "").alias("visual_review"),
    )


def _concrete(c: str) -> str:
    return f"coalesce(trim({c}) <> '' AND NOT contains({c}, '{{{{'), false)"


RECORDS_SQL = f"""(SELECT o_orderkey AS record_id, list_extract(['blocked', 'reviewed', 'omitted-with-reason', 'odd', 'pending', NULL], (o_orderkey % 6 + 1)::INT) AS status,
    list_extract(['because', ' ', NULL, '{{{{REASON}}}}'], (o_orderkey // 7 % 4 + 1)::INT) AS reason, list_extract(['retry', '', NULL], (o_orderkey // 3 % 3 + 1)::INT) AS next_action,
    list_extract(['pass', NULL, 'maybe'], (o_orderkey // 5 % 3 + 1)::INT) AS compile_check, list_extract([NULL, 'fail', ''], (o_orderkey // 11 % 3 + 1)::INT) AS visual_review FROM orders)"""
KNOWN = "status IN ('pending', 'in-progress', 'rebuilt', 'reviewed', 'blocked', 'omitted-with-reason')"
RECORD_TESTS = {
    "missing-status": "status IS NULL", "unknown-status": f"NOT ({KNOWN})", "blocked-without-reason": f"status = 'blocked' AND NOT {_concrete('reason')}", "blocked-without-next-action": f"status = 'blocked' AND NOT {_concrete('next_action')}",
    "omitted-without-reason": f"status = 'omitted-with-reason' AND NOT {_concrete('reason')}", "unknown-compile-check": f"{KNOWN} AND compile_check NOT IN ('not-run', 'pass', 'fail')", "unknown-visual-review": f"{KNOWN} AND visual_review NOT IN ('not-run', 'pass', 'fail', 'not-applicable')",
}


@query("record_completeness", " UNION ALL ".join(f"SELECT record_id::VARCHAR AS entity_key, '{n}' AS rule_id FROM {RECORDS_SQL} WHERE {t}" for n, t in RECORD_TESTS.items()))
def q_records(spark: SparkSession, d: str) -> DataFrame:
    return rules.record_violations(_records(spark, d), F.col("record_id")).select("entity_key", "rule_id")


@query("field_differences", """
    SELECT doc_id, field, l AS left_value, r AS right_value FROM (
      SELECT doc_id, unnest(['lang', 'source']) AS field, unnest([a.lang, a.source]) AS l, unnest([CASE WHEN doc_id % 6 = 0 THEN NULL ELSE a.lang END, CASE WHEN doc_id % 4 = 0 THEN 'src0' ELSE a.source END]) AS r FROM documents a) WHERE l IS DISTINCT FROM r
""")  # fmt: skip
def q_differences(spark: SparkSession, d: str) -> DataFrame:
    a = tables.table(spark, d, "documents").select("doc_id", "lang", "source")
    b = a.select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 == 0, "src0").otherwise(F.col("source")).alias("source"))
    return rules.field_differences(a, b, "doc_id", ["lang", "source"])


# Patterns that occur in the test data, in place of a compiler's messages.
ERRORS = (("upper-noise", r"!!.*!!"), ("symbol-noise", r"&&&|%%%"), ("insult", r"(?i)\b(?:idiot|moron)\b"))
WARNINGS = (("table-row", r"\|.+\|"), ("licence", r"Licensed under"), ("address", r"@[a-z]+\.[a-z]+"))
LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
CASES = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{s}/{c}'" for s, ps in (("ERROR", ERRORS), ("WARN", WARNINGS)) for c, p in ps)
FINDINGS_SQL = f"(SELECT DISTINCT split_part(m, '/', 1) AS severity, split_part(m, '/', 2) AS category, trim(line) AS message, doc_id || ':' || line_no AS source FROM (SELECT *, CASE {CASES} END AS m FROM {LINES_SQL}) WHERE m IS NOT NULL)"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.log_findings(tables.document_lines(spark, d), "doc_id", ERRORS, WARNINGS)


@query("log_findings", f"SELECT severity, category, md5(message) AS message_md5, source FROM {FINDINGS_SQL}")
def q_findings(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("severity", "category", F.md5("message").alias("message_md5"), "source")


@query("finding_counts", f"SELECT category, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings FROM {FINDINGS_SQL} GROUP BY category")
def q_finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.finding_counts(_findings(spark, d), ["category"])


@query("findings_sorted", f"SELECT row_number() OVER (ORDER BY severity <> 'ERROR', category, message, source) AS place, severity, category, source FROM {FINDINGS_SQL}")
def q_sorted(spark: SparkSession, d: str) -> DataFrame:
    """All findings with their places in order."""
    return ordered.places(_findings(spark, d), findings.finding_order()).select("place", "severity", "category", "source")


@query("artifact_scan", rf"SELECT doc_id, line_no::INT AS line_no FROM {LINES_SQL} WHERE regexp_matches(line, '(?i)todo[\s_-]*math|###|\bunresolved[\s_-]+glyph')")
def q_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return findings.artifact_lines(tables.document_lines(spark, d), r"(?i)todo[\s_-]*math|###|\bunresolved[\s_-]+glyph").select("doc_id", "line_no")


PATHS_SQL = r"(SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages)"
HOSTS_SQL = f"(SELECT page_id, path, split_part(path, '/', 3) AS top FROM {PATHS_SQL})"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Page paths under /site: the part after the host decides the root."""
    return tables.page_urls(spark, d).select("page_id", F.concat(F.lit("/site/"), F.element_at(F.split("path", "/"), 3), F.lit("/"), "page_id").alias("path"))


CATEGORY_SQL = f"(SELECT page_id, '/site/' || top || '/' || page_id AS path, CASE WHEN top IN ('en', 'de') THEN 'project' WHEN top IN ('en', 'fr') THEN 'system' ELSE 'external' END AS category FROM {HOSTS_SQL})"
ROOTS = [("project", "/site/en"), ("project", "/site/de/"), ("system", "/site/en"), ("system", "/site/fr")]


@query("dependency_closure", f"SELECT page_id, path, category FROM {CATEGORY_SQL}")
def q_dependencies(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([(i, c, f) for i, (c, f) in enumerate(ROOTS)], "priority int, category string, folder string")
    return findings.dependency_categories_by_table(_paths(spark, d), roots)


@query("dependency_report", f"SELECT c AS category, count(path) AS paths, coalesce(min(path), 'none') AS first_path, coalesce(max(path), 'none') AS last_path FROM (SELECT unnest(['project', 'system', 'external', 'unused']) AS c) LEFT JOIN {CATEGORY_SQL} ON c = category GROUP BY c")
def q_report(spark: SparkSession, d: str) -> DataFrame:
    return findings.dependency_report(findings.dependency_categories(_paths(spark, d), ROOTS), ["project", "system", "external", "unused"])


@query("stage_reduce", """
    WITH s AS (SELECT l_orderkey AS run_id, l_linenumber * 1000000 + l_partkey AS stage_no, CASE WHEN l_tax > 0.075 THEN 'FAIL' WHEN l_tax < 0.01 THEN 'INCOMPLETE' ELSE 'PASS' END AS status FROM lineitem),
    f AS (SELECT run_id, min(stage_no) FILTER (status = 'FAIL') AS failed_at FROM s GROUP BY run_id)
    SELECT run_id, count(*) AS stages_run, max(failed_at) AS failed_at, CASE WHEN max(failed_at) IS NOT NULL THEN 1 WHEN bool_or(status = 'INCOMPLETE') THEN 2 ELSE 0 END AS exit_code
    FROM s JOIN f USING (run_id) WHERE failed_at IS NULL OR stage_no <= failed_at GROUP BY run_id
""")  # fmt: skip
def q_stages(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_tax") > 0.075, "FAIL").when(F.col("l_tax") < 0.01, "INCOMPLETE").otherwise("PASS")
    stages = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("stage_no"), status.alias("status"))
    return findings.reduce_stages(stages, ["run_id"])


@query("markdown_records")
def q_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as state files: each turn's whole text in a record, with a fence or comment around some.

    SQL has no such parser; the tests hold it against one that goes line by line.
    """
    turn = F.concat(F.lit("### Turn: "), "turn", F.lit("\nStatus: "), F.when(F.col("role") == "user", "reviewed").otherwise("blocked"), F.lit("\nReason: "), F.coalesce("text", F.lit("")))
    wrapped = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("```\n"), turn, F.lit("\n````"))).when(F.col("turn") % 5 == 4, F.concat(F.lit("<!-- "), turn, F.lit("\n-->"))).otherwise(turn)
    files = tables.table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", wrapped.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return markdown.records(markdown.markdown_lines(files))


@query("X_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, sum(value) AS total FROM events GROUP BY ALL")
def x_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly windows of events."""
    return ingest.usage_by_window(tables.table(spark, d, "events"))


@query("X_sessions", """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, k
""")  # fmt: skip
def x_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions of users."""
    return ingest.sessions(tables.table(spark, d, "events"))


@query("X_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def x_rollup(spark: SparkSession, d: str) -> DataFrame:
    """An extension: totals by status and priority at every level."""
    return tables.table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("X_rank", "SELECT n_name, c_custkey, rank() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY place <= 3")
def x_rank(spark: SparkSession, d: str) -> DataFrame:
    """An extension: each nation's three customers of the largest balance; Spark limits the groups before it ranks them whole."""
    from pyspark.sql import Window

    # nation has 25 rows by its definition
    rows = tables.table(spark, d, "customer").join(F.broadcast(tables.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("place", F.rank().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"))).cast("long")).where("place <= 3").select("n_name", "c_custkey", "place")
