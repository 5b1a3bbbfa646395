"""Queries on range unions, lookups in order, ordered contracts, accepted sources, and lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acceptance, lifecycle, markdown_pieces, ranges, raster, rules
from ..sources import files, tables
from .page_queries import query

# A document is a token of its source's page selection: one page, a range, and now and then a very long one.
TOKEN = """
    coalesce(source, '') AS request_id, 1 + (doc_id * 7919) % 1000003 AS a,
    CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 997 = 1 THEN 900000000 ELSE (doc_id % 97) * 5 END AS more
"""
TOKENS_SQL = f"(SELECT request_id, a, a + more AS z FROM (SELECT {TOKEN} FROM documents))"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "documents").selectExpr(*[x.strip() for x in _split(TOKEN)])
    text = F.when(F.col("more") == 0, F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), (F.col("a") + F.col("more")).cast("string")))
    return rows.select("request_id", text.alias("selection"), F.lit(2_000_000_000).alias("page_count"))


def _split(columns: str) -> list[str]:
    from .shard_queries import _split as split

    return split(columns)


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of all tokens; a source's tokens lie in many rows, as one source may hold most of them."""
    return ranges.selection_ranges(_tokens(spark, d).withColumn("request_id", F.struct("request_id", F.monotonically_increasing_id().alias("no")))).select(F.col("request_id.request_id").alias("request_id"), "first", "last")


@query("selection_union", f"""
    WITH m AS (SELECT *, max(z) OVER (PARTITION BY request_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {TOKENS_SQL}),
    i AS (SELECT *, count(*) FILTER (before IS NULL OR a > before + 1) OVER (PARTITION BY request_id ORDER BY a, z) AS island FROM m)
    SELECT request_id, min(a) AS first_page, max(z) AS last_page FROM i GROUP BY request_id, island
""")  # fmt: skip
def q_union(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a source's tokens select, as disjoint ranges."""
    return ranges.merged_ranges(_ranges(spark, d), "request_id")


@query("selection_depth", f"""
    WITH e AS (SELECT request_id, pos, sum(c) AS c FROM (SELECT request_id, a AS pos, 1 AS c FROM {TOKENS_SQL} UNION ALL SELECT request_id, z + 1, -1 FROM {TOKENS_SQL}) GROUP BY ALL HAVING sum(c) <> 0),
    s AS (SELECT *, sum(c) OVER w AS depth, lead(pos) OVER w AS next FROM e WINDOW w AS (PARTITION BY request_id ORDER BY pos))
    SELECT request_id, pos AS first_page, next - 1 AS last_page, depth::BIGINT AS depth FROM s WHERE depth > 0
""")  # fmt: skip
def q_depth(spark: SparkSession, d: str) -> DataFrame:
    """How often pages are selected, as ranges of one depth."""
    return ranges.range_depths(_ranges(spark, d), "request_id")


LOG = "'/site/' || CAST(page_id % 20 AS STRING) || '/logs/' || CAST(page_id AS STRING) || '.log'"
VALUE = "CASE WHEN page_id % 11 = 0 THEN '/abs/./x/../' || CAST(page_id % 7 AS STRING) || '.bib' WHEN page_id % 5 = 0 THEN '../f' || CAST(page_id % 50 AS STRING) || '.bib' ELSE 'f' || CAST(page_id % 50 AS STRING) || '.bib' END"


@query("input_lookup", f"""
    WITH v AS (SELECT DISTINCT {LOG} AS path, {VALUE} AS value, page_id % 20 AS k FROM pages),
    there AS (SELECT '/site/' || page_id % 20 || '/logs/f' || page_id % 50 || '.bib' AS p FROM pages WHERE page_id % 3 = 0 UNION SELECT '/site/' || page_id % 20 || '/f' || page_id % 50 || '.bib' FROM pages WHERE page_id % 4 = 0 UNION SELECT '/site/f' || page_id % 50 || '.bib' FROM pages WHERE page_id % 7 = 0),
    look AS (SELECT 'f' || page_id % 50 || '.bib' AS name, min('/sys/' || page_id || '.bib') AS found FROM pages WHERE page_id % 13 = 0 GROUP BY name),
    t AS (SELECT *, CASE WHEN starts_with(value, '../') THEN '/site/' || k || '/' || substr(value, 4) ELSE '/site/' || k || '/logs/' || value END AS a, CASE WHEN starts_with(value, '../') THEN '/' || substr(value, 4) ELSE '/site/' || value END AS b,
                 CASE WHEN starts_with(value, '../') THEN '/shared/' || substr(value, 4) ELSE '/shared/lib/' || value END AS c FROM v)
    SELECT path, value, CASE WHEN starts_with(value, '/') THEN '/abs/' || regexp_extract(value, '[^/]*$') WHEN a IN (SELECT p FROM there) THEN a WHEN c IN (SELECT p FROM there) THEN c WHEN b IN (SELECT p FROM there) THEN b ELSE coalesce((SELECT found FROM look WHERE name = value), b) END AS resolved,
           CASE WHEN starts_with(value, '/') THEN 'absolute' WHEN a IN (SELECT p FROM there) THEN 'beside' WHEN c IN (SELECT p FROM there) THEN '/shared/lib' WHEN b IN (SELECT p FROM there) THEN '/site' WHEN (SELECT found FROM look WHERE name = value) IS NOT NULL THEN 'lookup' END AS found_in
    FROM t
""")  # fmt: skip
def q_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Files that logs name, looked for beside the log, in a library, in the project, and in a table of names, in this order."""
    pages = tables.table(spark, d, "pages").select("page_id")
    values = pages.selectExpr(f"{LOG} AS path", f"{VALUE} AS value")
    name = "'f' || CAST(page_id % 50 AS STRING) || '.bib'"
    kinds = (("page_id % 3 = 0", f"'/site/' || CAST(page_id % 20 AS STRING) || '/logs/' || {name}"), ("page_id % 4 = 0", f"'/site/' || CAST(page_id % 20 AS STRING) || '/' || {name}"), ("page_id % 7 = 0", f"'/site/' || {name}"))
    present = pages.select(F.explode(F.array_compact(F.array(*[F.expr(f"CASE WHEN {test} THEN {path} END") for test, path in kinds]))).alias("path"))
    known = pages.selectExpr(f"CASE WHEN page_id % 13 = 0 THEN {name} END AS name", "'/sys/' || CAST(page_id AS STRING) || '.bib' AS found").where("name IS NOT NULL")
    return files.resolve_inputs(values, present, "/site", [files.BESIDE, "/shared/lib", "/site"], known)


# A source's documents are the rules of a contract; the contract that is checked lacks some, has others, changed and moved ones.
CONTRACT = "coalesce(source, '') AS contract, CAST(doc_id AS STRING) AS rule_id, doc_id AS place, lang AS required, n_chars AS size"
ACTUAL = "coalesce(source, '') AS contract, CASE WHEN doc_id % 23 = 0 THEN 'new-' || CAST(doc_id AS STRING) ELSE CAST(doc_id AS STRING) END AS rule_id, CASE WHEN doc_id % 19 = 0 THEN doc_id + 1000003 ELSE doc_id END AS place, CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END AS required, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE n_chars END AS size"


@query("contract_check", f"""
    WITH e AS (SELECT {CONTRACT} FROM documents), a AS (SELECT {ACTUAL} FROM documents),
    b AS (SELECT coalesce(e.contract, a.contract) AS contract, coalesce(e.rule_id, a.rule_id) AS rule_id, e.place AS expected_place, a.place AS actual_place, e.rule_id IS NOT NULL AS wanted, a.rule_id IS NOT NULL AS there,
                 concat_ws(',', CASE WHEN e.required IS DISTINCT FROM a.required THEN 'required' END, CASE WHEN e.size IS DISTINCT FROM a.size THEN 'size' END) AS differ FROM e FULL JOIN a ON e.contract = a.contract AND e.rule_id = a.rule_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY expected_place) <> row_number() OVER (PARTITION BY contract ORDER BY actual_place) AS moved FROM b WHERE wanted AND there)
    SELECT contract, rule_id, CASE WHEN NOT there THEN 'missing' WHEN NOT wanted THEN 'unexpected' ELSE 'changed:' || differ END AS problem, expected_place, actual_place FROM b WHERE NOT there OR NOT wanted OR differ <> ''
    UNION ALL SELECT contract, rule_id, 'moved', expected_place, actual_place FROM c WHERE moved
""")  # fmt: skip
def q_contract(spark: SparkSession, d: str) -> DataFrame:
    """How stored contracts differ from what they should be, in rules and in their order."""
    docs = tables.table(spark, d, "documents")
    actual, expected = docs.selectExpr(*_split(ACTUAL)), docs.selectExpr(*_split(CONTRACT))
    return rules.ordered_differences(actual, expected, ["contract"], "rule_id", "place", ["required", "size"])


# A document's recorded identity, and how it is seen now; changes of English documents are accepted.
RECORDED_ID = "doc_id, lang || CAST(n_chars AS STRING) AS digest, n_chars AS size, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1 END AS page_count"
SEEN_ID = "doc_id, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE lang || CAST(n_chars AS STRING) END AS digest, CASE WHEN doc_id % 13 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 21 = 0 THEN 2 WHEN doc_id % 7 = 0 THEN NULL ELSE 1 END AS page_count"


@query("source_acceptance", f"""
    WITH r AS (SELECT {RECORDED_ID} FROM documents WHERE doc_id % 31 <> 0), s AS (SELECT {SEEN_ID} FROM documents WHERE doc_id % 37 <> 0),
    d AS (
      SELECT doc_id, r.doc_id IS NOT NULL AS old, s.doc_id IS NOT NULL AS new, concat_ws(',', CASE WHEN r.digest IS DISTINCT FROM s.digest THEN 'digest' END, CASE WHEN r.size IS DISTINCT FROM s.size THEN 'size' END, CASE WHEN r.page_count IS DISTINCT FROM s.page_count THEN 'page_count' END) AS differ
      FROM r FULL JOIN s USING (doc_id)),
    k AS (SELECT doc_id, CASE WHEN NOT old THEN 'new' WHEN NOT new THEN 'gone' WHEN differ = '' THEN 'same' WHEN doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') THEN 'accepted' ELSE 'refused' END AS decision, CASE WHEN old AND new THEN differ ELSE '' END AS changed FROM d),
    n AS (SELECT doc_id, count(*) AS labels FROM labels GROUP BY doc_id)
    SELECT doc_id, decision, changed, coalesce(labels, 0) AS labels_before, CASE WHEN decision = 'accepted' THEN 0 ELSE coalesce(labels, 0) END AS labels_after FROM k LEFT JOIN n USING (doc_id)
""")  # fmt: skip
def q_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each source whose identity is seen again, and of its records in the table of labels."""
    docs, labels = tables.table(spark, d, "documents"), tables.table(spark, d, "labels").select("doc_id")
    # a row of either side that is missing is a source that is new, or gone
    recorded, seen = docs.where("doc_id % 31 <> 0").selectExpr(*_split(RECORDED_ID)), docs.where("doc_id % 37 <> 0").selectExpr(*_split(SEEN_ID))
    decided = acceptance.decisions(recorded, seen, docs.where("lang = 'en'").select("doc_id"), "doc_id", ["digest", "size", "page_count"])
    counts = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    out = decided.join(counts(labels, "labels_before"), "doc_id", "left").join(counts(acceptance.left_after(labels, decided, "doc_id"), "labels_after"), "doc_id", "left")
    return out.select("doc_id", "decision", "changed", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("labels_before", "labels_after")])


STATUS = "element_at({array}('pending', 'in-progress', 'rebuilt', 'reviewed', 'blocked', 'omitted-with-reason'), CAST(1 + (length(coalesce(text, '')) + turn) % 6 AS INT))"


@query("lifecycle_replay", f"""
    WITH RECURSIVE e AS (SELECT conv_id, turn, {STATUS.format(array="list_value").replace("element_at", "list_extract")} AS status, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    allowed(a, b) AS (VALUES {", ".join(f"('{a or ''}', '{b}')" for a, to in lifecycle.TRANSITIONS.items() for b in to)}),
    w AS (
      SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS turn, '' AS came, '' AS status, false AS ok, '' AS now FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT w.conv_id, e.n, e.turn, w.now, e.status, a.b IS NOT NULL, CASE WHEN a.b IS NOT NULL THEN e.status ELSE w.now END FROM w JOIN e ON e.conv_id = w.conv_id AND e.n = w.n + 1 LEFT JOIN allowed a ON a.a = w.now AND a.b = e.status)
    SELECT conv_id, turn, nullif(came, '') AS from_status, status AS to_status, CASE WHEN ok THEN 'applied' WHEN came = status THEN 'repeated' ELSE 'illegal' END AS outcome FROM w WHERE n > 0
""")  # fmt: skip
def q_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns as status events of a page: each is applied, or refused from the status that stands."""
    events = tables.table(spark, d, "conversations").select("conv_id", "turn", F.expr(STATUS.format(array="array")).alias("status"))
    return lifecycle.replay(events, "conv_id", "turn").select("conv_id", "turn", "from_status", "to_status", "outcome")


@query("markdown_pieces")
def q_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Active lines of documents as Markdown files that are cut into pieces of 200 lines; the tests hold it against whole files."""
    docs = tables.table(spark, d, "documents").select(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8)).alias("path"), "text").dropDuplicates(["path"])
    fence = F.when(F.crc32("path") % 4 == 0, F.concat(F.lit("~~~~\n"), F.replace("text", F.lit("\n"), F.lit("\n~~~\n")))).when(F.crc32("path") % 4 == 1, F.concat(F.lit("<!-- "), F.replace("text", F.lit(". "), F.lit(" -->\n<!--")))).otherwise(F.col("text"))
    lines = markdown_pieces.active_lines(markdown_pieces.cut(docs.withColumn("text", fence), 200))
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.col("line_no").cast("long")).alias("line_nos"), F.sum(F.crc32("line")).alias("crc"))


TILES = "transform({array}, x -> CAST(floor((CAST(x AS DOUBLE) + 1) * 32) AS INT))"


@query("tiled_coverage", """
    WITH s AS (SELECT label AS raster_id, vec_id AS tile, unnest(range(0, len(embedding))) AS pos, floor((unnest(embedding)::DOUBLE + 1) * 32)::INT AS v FROM embeddings WHERE embedding IS NOT NULL),
    h AS (SELECT raster_id, v, count(*) AS n, min((tile::HUGEINT << 32) + pos) AS first FROM s GROUP BY raster_id, v),
    m AS (SELECT raster_id, arg_max(v, n * 1000000000000000000000000::DOUBLE - first::DOUBLE) AS background FROM h GROUP BY raster_id)
    SELECT raster_id, background, sum(CASE WHEN abs(v - background) > 1 THEN n ELSE 0 END)::BIGINT / sum(n)::BIGINT AS coverage FROM h JOIN m USING (raster_id) GROUP BY raster_id, background
""")  # fmt: skip
def q_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A label's vectors as the tiles of one raster: their histograms are merged, no sample is shuffled."""
    rows = tables.table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("label").alias("raster_id"), F.col("vec_id").alias("tile"), F.expr(TILES.format(array="embedding")).alias("samples"))
    return raster.pixel_coverage(rows, "raster_id", maximum=64, tile="tile")
