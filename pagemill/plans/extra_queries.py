"""Queries on validation, sources, artifacts, templates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import findings, ledger, markdown, ordered, rules
from ..sources import tables
from .ledger_queries import NEW_SQL, _new
from .page_queries import query
from .rule_queries import CONTEXT_SQL, RECORDED_SQL, _recorded, required_sql
from .shard_queries import _split


@query("text_functions", r"""
    SELECT page_id, printf('page-%03d.png', page_id) AS file_name, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\.[^./]+)$', 1)) AS suffix,
           regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS is_batch, page_id % 2 = 0 AS is_digest,
           page_id % 7 || ',' || page_id % 11 || ',' || page_id % 3 AS version, (page_id % 4 + CASE WHEN page_id % 3 = 0 THEN 4 - page_id % 4 ELSE 0 END)::INT AS indent,
           page_id % 5 <> 0 AND page_id % 7 <> 0 AS safe
    FROM pages
""")  # fmt: skip
def q_text(spark: SparkSession, d: str) -> DataFrame:
    """File names, suffixes, patterns, versions, indentation and safe values, from page numbers and addresses."""
    no = F.col("page_id")
    digest = F.when(no % 2 == 0, F.sha2("url", 256)).otherwise(F.upper(F.concat(F.sha2("url", 256), F.lit("x"))))
    line = F.concat(F.repeat(F.lit(" "), (no % 4).cast("int")), F.when(no % 3 == 0, "\t").otherwise(""), F.lit("x"))
    value = F.concat(F.lit("title"), F.when(no % 5 == 0, " ").otherwise(""), F.when(no % 7 == 0, "<!-- x").otherwise(""))
    return tables.table(spark, d, "pages").select(
        "page_id", tx.page_file_name(no, "png").alias("file_name"), tx.suffix(F.regexp_replace("url", "[?#].*$", "")).alias("suffix"), tx.is_batch_id(F.col("url")).alias("is_batch"), tx.is_digest(digest).alias("is_digest"),
        F.array_join(F.transform(tx.version_parts(F.concat_ws(".", no % 7, no % 11, F.concat(F.lit("rc"), no % 3))), lambda x: x.cast("string")), ",").alias("version"), tx.indent_columns(line).alias("indent"), tx.is_safe_scalar(value).alias("safe"),
    )


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def q_times(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("event_id", tx.iso_time(F.col("ts")).alias("at"))


@query("template_fill", "SELECT n_nationkey, n_name || ' in ' || r_name || ': ' || n_name || ' {{OTHER}} {{lower}}' AS filled, 'OTHER' AS unknown FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_template(spark: SparkSession, d: str) -> DataFrame:
    both = tables.table(spark, d, "nation").join(F.broadcast(tables.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions by definition
    template, values = F.lit("{{NAME}} in {{REGION}}: {{NAME}} {{OTHER}} {{lower}}"), F.create_map(F.lit("NAME"), "n_name", F.lit("REGION"), "r_name")
    return both.select("n_nationkey", tx.fill_template(template, values).alias("filled"), F.array_join(tx.unknown_placeholders(template, values), ",").alias("unknown"))


@query("brace_expansion", "SELECT c_custkey, '/a/' || c_custkey || '/x|/a/' || c_custkey || '/y|/b|' || c_mktsegment AS parts FROM customer")
def q_braces(spark: SparkSession, d: str) -> DataFrame:
    paths = F.concat(F.lit("!!/a/"), "c_custkey", F.lit("/{x,y}//:;/b/: "), "c_mktsegment")
    return tables.table(spark, d, "customer").select("c_custkey", F.array_join(tx.expand_braces(paths), "|").alias("parts"))


FILES_SQL = required_sql(rules.FILE_RULES, "file")


@query("file_validation", f"SELECT context_id::VARCHAR AS entity_key, 'missing-file' AS rule_id, file AS detail FROM ({FILES_SQL}) WHERE (context_id + length(file)) % 3 = 0")
def q_missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Required files against a listing that lacks a third of them and has others."""
    contexts, table = tables.contexts(spark, d), rules.rule_table(spark, rules.FILE_RULES)
    needed = rules.requirements(contexts, table).select("context_id", F.col("required").alias("file"))
    present = needed.where((F.col("context_id") + F.length("file")) % 3 != 0).unionByName(contexts.select("context_id", F.lit("notes.md").alias("file")))
    return rules.file_violations(contexts, present, table).drop("entity")


LIFE_SQL = "(SELECT o_custkey AS context_id, list_extract(['blocked', 'reviewed', 'omitted-with-reason', 'pending', 'reviewed'], (o_orderkey % 5 + 1)::INT) AS status FROM orders)"


@query("lifecycle_validation", f"""
    WITH p AS (SELECT context_id, bool_or(status = 'blocked') AS blocked, count(*) FILTER (status NOT IN ('reviewed', 'omitted-with-reason')) AS open FROM {LIFE_SQL} GROUP BY context_id), c AS (SELECT context_id, outcome, blocked, open FROM {CONTEXT_SQL} LEFT JOIN p USING (context_id))
    SELECT context_id::VARCHAR AS entity_key, 'blocked-needs-record' AS rule_id, '' AS detail FROM c WHERE outcome = 'blocked' AND NOT coalesce(blocked, false)
    UNION ALL SELECT context_id::VARCHAR, 'final-with-open-records', open::VARCHAR FROM c WHERE outcome IN ('complete', 'downgraded') AND coalesce(open, 0) > 0
""")  # fmt: skip
def q_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("blocked", "reviewed", "omitted-with-reason", "pending", "reviewed"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    records = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("context_id"), status.alias("status"))
    return rules.lifecycle_violations(tables.contexts(spark, d), records).drop("entity")


@query("unblocked_gates", f"SELECT context_id, gate FROM (SELECT context_id, gate, CASE status WHEN 'pending' THEN 'blocked' ELSE status END AS status FROM {RECORDED_SQL}) WHERE status = 'blocked' AND NOT ((context_id % 2 = 0) AND gate <> 'artifact-scan')")
def q_unblocked(spark: SparkSession, d: str) -> DataFrame:
    """Blocked gates without a record that says why."""
    gates = _recorded(spark, d).withColumn("status", F.when(F.col("status") == "pending", "blocked").otherwise(F.col("status")))
    blockers = gates.where("context_id % 2 = 0 and gate <> 'artifact-scan'").select("context_id", "gate").distinct()
    return rules.unblocked_gates(gates, blockers, ["context_id", "gate"]).select("context_id", "gate")


PART_RULES = """
    p_partkey AS k, 'rule-' || CASE WHEN p_partkey % 29 = 0 THEN '0' ELSE CAST(p_partkey AS STRING) END AS id, p_partkey % 7 AS o, p_partkey % 11 AS t, p_partkey % 13 = 0 AS bare
"""


@query("rule_validation", f"""
    WITH r AS (SELECT {PART_RULES} FROM part)
    SELECT id AS entity_key, 'operation' AS rule_id, 'convert,paint' AS detail FROM r WHERE o = 1 UNION ALL SELECT id, 'traits_any', 'book,odd' FROM r WHERE t = 0 UNION ALL SELECT id, 'traits_all', 'even' FROM r WHERE t = 2
    UNION ALL SELECT id, 'nothing-required', '' FROM r WHERE bare UNION ALL SELECT id, 'repeated-id', count(*)::VARCHAR FROM r GROUP BY id HAVING count(*) > 1
""")  # fmt: skip
def q_rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a contract's rules, some of which name what doesn't exist, require nothing, or repeat an id."""
    text = "array<string>"
    part = tables.table(spark, d, "part").selectExpr(*_split(PART_RULES))
    lists = {
        "operation": "CASE WHEN o = 0 THEN NULL WHEN o = 1 THEN array('convert', 'paint') ELSE array('resume') END", "traits_any": "CASE WHEN t = 0 THEN array('book', 'odd') WHEN t = 1 THEN NULL ELSE array('cjk') END",
        "traits_all": "CASE WHEN t = 2 THEN array('even') END", "required": "CASE WHEN bare THEN array() ELSE array('a.md') END",
    }
    none = {f: "NULL" for f in rules.CONDITIONS if f not in lists}
    table = part.selectExpr("CAST(k AS INT) AS rule_no", "id AS rule_id", *[f"CAST({e} AS {text}) AS {f}" for f, e in (lists | none).items()])
    return rules.rule_violations(table.select("rule_no", "rule_id", *rules.CONDITIONS, "required")).drop("entity")


TOOLS = ("latexmk", "xelatex", "pdftoppm", "mutool", "pdftotext", "pdfinfo", "pdfseparate", "biber", "bibtex", "makeindex", "makeglossaries")
HAS = {t: f"s_suppkey // {2**i} % 2 = 1" for i, t in enumerate(TOOLS)}


def _yes(tool: str) -> str:
    return f"CASE WHEN {HAS[tool]} THEN 'available' ELSE 'unavailable' END"


CAPABILITY_SQL = f"""(SELECT s_suppkey AS host, CASE WHEN {HAS['latexmk']} AND {HAS['xelatex']} THEN 'full' WHEN {HAS['xelatex']} THEN 'simple-only' ELSE 'unavailable' END AS compile,
    CASE WHEN {HAS['pdftoppm']} THEN 'pdftoppm' WHEN {HAS['mutool']} THEN 'mutool' ELSE 'unavailable' END AS render, {_yes('pdftotext')} AS text_layer, {_yes('pdfinfo')} AS pdf_metadata, {_yes('pdfseparate')} AS single_page,
    coalesce(nullif(concat_ws(',', CASE WHEN {HAS['biber']} THEN 'biber' END, CASE WHEN {HAS['bibtex']} THEN 'bibtex' END), ''), 'unavailable') AS bibliography, {_yes('makeindex')} AS index, {_yes('makeglossaries')} AS glossary FROM supplier)"""


def _capability(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    tools = F.array_compact(F.array(*[F.when(F.floor(key / 2**i) % 2 == 1, F.lit(t)) for i, t in enumerate(TOOLS)]))
    return rules.tool_capability(tables.table(spark, d, "supplier").select(key.alias("host"), tools.alias("tools")))


@query("tool_capability", f"SELECT * FROM {CAPABILITY_SQL}")
def q_capability(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as hosts: the bits of their keys are their tools."""
    return _capability(spark, d).withColumn("bibliography", F.array_join("bibliography", ","))


@query("capability_failures", f"""
    SELECT host, concat_ws(',', CASE WHEN compile = 'unavailable' THEN 'XeLaTeX' END, CASE WHEN pdf_metadata = 'unavailable' THEN 'pdfinfo' END, CASE WHEN render = 'unavailable' THEN 'pdftoppm or mutool' END,
           CASE WHEN compile <> 'full' THEN 'latexmk + XeLaTeX' END, CASE WHEN text_layer = 'unavailable' THEN 'pdftotext' END) AS failures FROM {CAPABILITY_SQL}
""")  # fmt: skip
def q_failures(spark: SparkSession, d: str) -> DataFrame:
    return rules.capability_failures(_capability(spark, d), "publication").withColumn("failures", F.array_join("failures", ","))


@query("text_file_selection", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND text IS NOT NULL")
def q_text_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: a fifth begin with a NUL, a fifth have one far behind, a seventh lie among logs."""
    no = F.col("doc_id")
    text = F.when(no % 5 == 0, F.concat(F.lit("\x00"), "text")).when(no % 5 == 1, F.concat("text", F.repeat(F.lit(" "), 8192), F.lit("\x00"))).otherwise(F.col("text"))
    files = tables.table(spark, d, "documents").select("doc_id", F.concat(F.when(no % 7 == 0, "logs/").otherwise("src/"), no.cast("string")).alias("relative"), F.encode(text, "UTF-8").alias("content"))
    return findings.text_files(files).select("doc_id")


def _tex(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("page_id")
    line = (
        F.when(no % 6 == 0, F.concat(F.lit(r"\input{a,"), no, F.lit(r"} \include{b} % \input{c}"))).when(no % 6 == 1, F.concat(F.lit(r"\bibliography{x"), no, F.lit(", y}")))
        .when(no % 6 == 2, F.concat(F.lit(r"\includegraphics [width=1cm] {p"), no, F.lit(r"} \bibliographystyle{plain}"))).when(no % 6 == 3, F.lit(r"\input{\name} \input{#1} \immediate\write18{ls}"))
        .when(no % 6 == 4, F.concat(F.lit(r"\addbibresource{r"), no, F.lit("}"))).otherwise(F.lit(r"\% \input{z} %\makeindex"))
    )
    return tables.table(spark, d, "pages").select("page_id", line.alias("line"))


@query("source_references", r"""
    SELECT page_id, 'input' AS command, 'a,' || page_id AS value FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT page_id, 'include', 'b' FROM pages WHERE page_id % 6 = 0
    UNION ALL SELECT page_id, 'bibliography', unnest(['x' || page_id, 'y']) FROM pages WHERE page_id % 6 = 1 UNION ALL SELECT page_id, 'includegraphics', 'p' || page_id FROM pages WHERE page_id % 6 = 2
    UNION ALL SELECT page_id, 'bibliographystyle', 'plain' FROM pages WHERE page_id % 6 = 2 UNION ALL SELECT page_id, 'addbibresource', 'r' || page_id FROM pages WHERE page_id % 6 = 4 UNION ALL SELECT page_id, 'input', 'z' FROM pages WHERE page_id % 6 = 5
""")  # fmt: skip
def q_references(spark: SparkSession, d: str) -> DataFrame:
    return findings.references(_tex(spark, d)).select("page_id", "command", "value")


@query("source_checks", "SELECT page_id, page_id % 6 = 3 AS shell_escape, page_id % 6 IN (1, 4) AS complex_build FROM pages WHERE page_id % 6 IN (1, 3, 4)")
def q_checks(spark: SparkSession, d: str) -> DataFrame:
    return findings.source_checks(_tex(spark, d)).drop("line")


@query("prefix_remap", "SELECT page_id, replace(url, '://', ':/project/') AS message FROM pages")
def q_remap(spark: SparkSession, d: str) -> DataFrame:
    return findings.remap_prefix(tables.table(spark, d, "pages").select("page_id", F.col("url").alias("message")), "://", ":/project/")


@query("missing_resources", "SELECT path, resource FROM (SELECT page_id, page_id::VARCHAR AS path, unnest(['refs/r' || page_id % 50 || '.md', 'assets/t' || page_id % 7]) AS resource FROM pages) WHERE NOT (resource LIKE 'refs/%' AND page_id % 50 < 40) AND resource <> 'assets/t3'")
def q_resources(spark: SparkSession, d: str) -> DataFrame:
    """Guides that name files, against a listing that lacks some."""
    no = F.col("page_id")
    files = tables.table(spark, d, "pages").select(no.cast("string").alias("path"), F.concat(F.lit("see refs/r"), no % 50, F.lit(".md, twice refs/r"), no % 50, F.lit(".md, and `assets/t"), no % 7, F.lit("`; not other/x.md")).alias("text"))
    listing = spark.createDataFrame([(f"refs/r{i}.md",) for i in range(40)] + [("assets/t3",)], "path string")
    return markdown.missing_resources(files, listing, ["refs", "assets"])


ARTIFACTS_SQL = "(SELECT o_orderkey AS batch_id, unnest([0, 1]) AS position, unnest(['out/' || o_custkey, 'log/' || o_orderkey]) AS path FROM orders)"
DIGESTS_SQL = f"(SELECT batch_id, position, path, CASE WHEN NOT (path LIKE 'log/%' AND batch_id % 6 = 0) THEN sha256(path) END AS sha256 FROM {ARTIFACTS_SQL})"


def _artifacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Shards of all orders with two artifacts each, and a listing that lacks a sixth of the logs."""
    key = F.col("o_orderkey")
    shards = tables.table(spark, d, "orders").select(key.alias("batch_id"), F.array(F.concat(F.lit("out/"), "o_custkey"), F.concat(F.lit("log/"), key)).alias("artifacts"))
    paths = shards.where("batch_id % 6 <> 0").select(F.element_at("artifacts", 2).alias("path")).unionByName(shards.select(F.element_at("artifacts", 1).alias("path")).distinct())
    return shards, paths.withColumn("sha256", F.sha2("path", 256))


@query("artifact_digests", f"SELECT batch_id, position, path, sha256 FROM {DIGESTS_SQL}")
def q_digests(spark: SparkSession, d: str) -> DataFrame:
    return ledger.artifact_digests(*_artifacts(spark, d))


@query("missing_artifacts", f"SELECT batch_id::VARCHAR AS entity_key, path AS detail FROM {DIGESTS_SQL} WHERE sha256 IS NULL")
def q_missing_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.missing_artifacts(*_artifacts(spark, d)).select("entity_key", "detail")


@query("same_artifacts", f"SELECT DISTINCT batch_id, batch_id % 6 <> 0 AND batch_id % 7 <> 0 AS same FROM {DIGESTS_SQL}")
def q_same(spark: SparkSession, d: str) -> DataFrame:
    """Digests of now against earlier ones: a sixth had another digest, a seventh had none."""
    now = ledger.artifact_digests(*_artifacts(spark, d))
    old = now.where("batch_id % 7 <> 0").withColumn("sha256", F.when(F.col("batch_id") % 6 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")))
    return ledger.same_artifacts(now, old).select("batch_id", F.coalesce("same", F.lit(False)).alias("same"))


MERGE_SQL = f"(SELECT n.batch_id, n.sha, batch_id % 2 AS source, CASE WHEN batch_id % 4 = 0 THEN 'out/other' ELSE 'out' END AS artifact FROM {NEW_SQL} n)"


def _merge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """New shards of all orders, and a ledger of the filled ones: another content for some, other artifacts for others."""
    page = (F.col("batch_id") % 1000).cast("int")
    extra = lambda df: df.select("batch_id", "shard_sha256", F.array(page).alias("owned_pages"), F.lit("s").alias("source_sha256"), F.lit(None).cast("string").alias("style_profile_sha256"))
    new = extra(_new(spark, d)).withColumn("artifacts", F.array(F.when(F.col("batch_id") % 4 == 0, "out/other").otherwise("out"))).withColumn("style_profile_sha256", F.when(F.col("batch_id") % 3 == 0, F.lit("p")))
    old = extra(tables.ledger_batches(spark, d)).withColumn("artifacts", F.array(F.lit("out"))).withColumn("style_profile_sha256", F.when(F.col("batch_id") % 5 == 0, F.lit("q")))
    return new.withColumn("source_sha256", F.when(F.col("batch_id") % 9 != 0, "s")), old


@query("ledger_artifact_match", f"""
    SELECT n.batch_id, CASE WHEN o.o_orderkey IS NULL THEN 'add' WHEN n.batch_id % 10 = 0 AND o.o_orderpriority <> 'changed' OR n.artifact <> 'out' THEN 'conflict' ELSE 'skip' END AS action
    FROM {MERGE_SQL} n LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = n.batch_id
""")  # fmt: skip
def q_match(spark: SparkSession, d: str) -> DataFrame:
    new, old = _merge(spark, d)
    return ledger.match_ledger(new, old).select("batch_id", "action")


@query("merge_validation", f"""
    WITH m AS (SELECT n.batch_id, o.o_orderkey IS NOT NULL AS there, n.batch_id % 10 = 0 OR n.artifact <> 'out' AS other FROM {MERGE_SQL} n LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = n.batch_id)
    SELECT 'batch' AS entity, batch_id::VARCHAR AS entity_key, 'content-conflict' AS rule_id, '' AS detail FROM m WHERE there AND other
    UNION ALL SELECT 'page', (batch_id % 1000)::VARCHAR, 'owned-twice', min(batch_id) || ',' || max(batch_id) FROM m GROUP BY batch_id % 1000 HAVING count(*) > 1
    UNION ALL SELECT 'ledger', 'source_sha256', 'identity-conflict', 'none,s' UNION ALL SELECT 'ledger', 'style_profile_sha256', 'snapshot-conflict', 'p,q'
""")  # fmt: skip
def q_merge(spark: SparkSession, d: str) -> DataFrame:
    """Everything that forbids a merge: contents, artifacts, owners, the source's identity and snapshots."""
    return ledger.merge_violations(*_merge(spark, d))


@query("output_conflicts", "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def q_outputs(spark: SparkSession, d: str) -> DataFrame:
    return ledger.output_conflicts(tables.table(spark, d, "documents").select("doc_id"), tables.table(spark, d, "labels"), ["doc_id"])


@query("source_invalidation", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 8 <> 0")
def q_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """Records of customers whose identity changed go."""
    records = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest"))
    now = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.sha2(F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 8 == 0, "x").otherwise("")), 256).alias("digest"))
    return ledger.invalidate(records, now, "o_custkey", ["digest"]).select("o_orderkey", "o_custkey")


@query("path_rebinding", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new/' || doc_id ELSE source END AS path FROM documents")
def q_rebind(spark: SparkSession, d: str) -> DataFrame:
    records = tables.table(spark, d, "documents").select("doc_id", F.col("source").alias("path"))
    moved = records.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("path"))
    return ledger.rebind_paths(records, moved, ["doc_id"])


@query("single_candidate", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def q_candidate(spark: SparkSession, d: str) -> DataFrame:
    return ledger.only_candidate(tables.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("listed_values", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS n_name FROM nation GROUP BY n_regionkey")
def q_listed(spark: SparkSession, d: str) -> DataFrame:
    return ledger.listed(tables.table(spark, d, "nation"), ["n_regionkey"], "n_name")


FOLDERS_SQL = "(SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/' || doc_id END AS path FROM documents)"


@query("folder_order", f"SELECT row_number() OVER (ORDER BY len(string_split(path, '/')) DESC, path) AS place, path FROM {FOLDERS_SQL}")
def q_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders, the deepest first, with their places in order."""
    no = F.col("doc_id")
    path = F.when(no % 3 == 0, F.col("source")).when(no % 3 == 1, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", no.cast("string")))
    folders = tables.table(spark, d, "documents").select(path.alias("path")).distinct()
    return ordered.places(folders, [F.size(F.split("path", "/")).desc(), F.col("path")]).select("place", "path")


@query("evidence_map", "SELECT o_custkey, '{' || string_agg('\"' || o_orderkey || '\":{\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey::VARCHAR) || '}' AS page_records FROM orders GROUP BY o_custkey")
def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The records of each customer's orders as one JSON map."""
    lines = tables.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("page"), "o_orderstatus")
    return ledger.evidence_map(lines, ["o_custkey"]).select("o_custkey", F.to_json("page_records").alias("page_records"))


@query("ledger_json", "SELECT o_orderkey AS batch_id, '{\"batch_id\":' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',\"status\":\"' || o_orderstatus || '\"' END || '}' AS record FROM orders")
def q_ledger_json(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return ledger.ledger_row(rows)


@query("last_marker", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
def q_marker(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last purchase of its user at or before it."""
    events = tables.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return findings.fill_forward(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")
