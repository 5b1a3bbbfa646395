"""Strict validation of shards: their JSON text is made of order lines, many of them with something wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shard_rules
from ..sources import tables
from .page_queries import query

# A line is a page record and an order a shard. These expressions mean the same in both dialects.
LINE = """
    l_orderkey AS k, l_linenumber AS n, CAST(l_linenumber AS STRING) AS t, l_partkey AS p, l_suppkey AS s, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS q, l_tax > 0.07 AS u,
    CASE WHEN l_partkey % 83 = 0 THEN '"reviewed"' WHEN l_partkey % 83 = 1 THEN 'null' WHEN l_partkey % 83 = 2 THEN '"omitted-with-reason"'
         WHEN l_returnflag = 'A' THEN '"rebuilt"' WHEN l_returnflag = 'N' THEN '"pending"' ELSE '"blocked"' END AS status
"""
RECORD = """
    CASE WHEN p % 97 = 0 THEN '7' ELSE
      '{"page":' || CASE WHEN p % 101 = 0 THEN '"' || t || '"' WHEN p % 101 = 1 THEN t || '.0' WHEN p % 101 = 2 THEN 'true' WHEN p % 101 = 3 THEN '0' ELSE t END
      || ',"route":' || CASE WHEN p % 89 = 0 THEN '" "' WHEN p % 89 = 1 THEN '5' ELSE '"digital-text"' END || ',"status":' || status
      || CASE WHEN status = '"blocked"' THEN CASE WHEN s % 3 = 0 THEN '' ELSE ',"reason":"why"' END || CASE WHEN s % 5 = 0 THEN ',"next_action":" "' ELSE ',"next_action":"go"' END ELSE '' END
      || CASE WHEN k % 2 = 1 THEN ',"block_count":' || q || ',"object_count":' || CASE WHEN p % 79 = 0 THEN '-1' WHEN p % 79 = 1 THEN 'true' ELSE CAST(p % 7 AS STRING) END
                || ',"continuity_count":' || CAST(s % 3 AS STRING) || ',"uncertainty_count":' || CASE WHEN u THEN '1' ELSE '0' END
              ELSE ',"blocks":["b"],"objects":[],"continuity":' || CASE WHEN p % 79 = 0 THEN '{}' ELSE '[]' END || ',"uncertainties":' || CASE WHEN u THEN '["u"]' ELSE '[]' END END
      || '}' END
"""
OWNED = "CASE WHEN p % 103 = 0 THEN t || '.5' WHEN p % 103 = 1 THEN '99' ELSE t END"
COUNTS = """count(CASE WHEN p % 97 <> 0 THEN 1 END) AS n_pages, count(CASE WHEN p % 97 <> 0 AND status = '"blocked"' THEN 1 END) AS n_blocked, count(CASE WHEN p % 97 <> 0 AND u THEN 1 END) AS n_uncertain"""
SHARD = """
    CASE WHEN k % 109 = 0 THEN '[' WHEN k % 109 = 1 THEN '"text"' ELSE
      '{"schema_version":' || CASE WHEN k % 53 = 0 THEN '3' WHEN k % 53 = 1 THEN '"1"' ELSE CAST(1 + k % 2 AS STRING) END
      || ',"kind":' || CASE WHEN k % 59 = 0 THEN '"other"' ELSE '"page-ir-shard"' END
      || ',"batch_id":' || CASE WHEN k % 61 = 0 THEN '"../b"' WHEN k % 61 = 1 THEN '7' ELSE '"batch-' || CAST(k AS STRING) || '"' END
      || ',"source":' || CASE WHEN k % 67 = 0 THEN 'null' ELSE '{"sha256":"' || CASE WHEN k % 67 = 1 THEN upper(sha256) ELSE sha256 END || '","size_bytes":'
           || CASE WHEN k % 67 = 2 THEN '"1000"' WHEN k % 67 = 4 THEN '5' ELSE CAST(size_bytes AS STRING) END || ',"page_count":' || CASE WHEN k % 67 = 3 THEN '7.0' ELSE '7' END || '}' END
      || CASE WHEN k % 127 = 0 THEN ',"owned_pages":"1-3"' WHEN k % 127 = 1 THEN ',"owned_pages":[]' ELSE ',"owned_pages":[' || owned || ']' END
      || ',"context_pages":' || CASE WHEN k % 71 = 0 THEN '"none"' WHEN k % 71 = 1 THEN '[1,1]' WHEN k % 71 = 2 THEN '[7,8]' ELSE '[]' END
      || ',"style_profile_sha256":' || CASE WHEN k % 73 = 0 THEN '"abc"' WHEN k % 73 = 1 THEN '5' ELSE 'null' END
      || ',"status":' || CASE WHEN k % 11 = 0 THEN '"blocked"' WHEN k % 11 = 1 THEN '"omitted-with-reason"' WHEN k % 11 = 2 THEN '"reviewed"' ELSE '"rebuilt"' END
      || ',"pages":' || CASE WHEN k % 107 = 0 THEN '{}' ELSE '[' || records || ']' END
      || CASE WHEN k % 31 = 0 THEN '' WHEN k % 31 = 1 THEN ',"worker_summary":[]' ELSE ',"worker_summary":{"text":"' || CASE WHEN k % 31 = 2 THEN ' ' WHEN k % 31 = 3 THEN repeat('x', 1201) ELSE 'done' END
           || '","owned_page_count":' || CASE WHEN k % 31 = 4 THEN '"2"' ELSE CAST(n_pages AS STRING) END || ',"blocked_page_count":' || CAST(n_blocked + CASE WHEN k % 31 = 5 THEN 1 ELSE 0 END AS STRING) || ',"uncertain_page_count":' || CAST(n_uncertain AS STRING) || '}' END
      || CASE WHEN k % 37 = 0 THEN ',"usage":null' WHEN k % 37 = 1 THEN ',"usage":[]' WHEN k % 37 = 2 THEN ',"usage":{"tokens":1,"input_tokens":2}' WHEN k % 37 = 3 THEN ',"usage":{"input_tokens":5.0}'
              WHEN k % 37 = 4 THEN ',"usage":{"input_tokens":1,"cached_input_tokens":2}' WHEN k % 37 = 5 THEN '' ELSE ',"usage":{"input_tokens":9,"retry_count":0}' END
      || ',"artifacts":' || CASE WHEN k % 41 = 0 THEN 'null' WHEN k % 41 = 1 THEN '["/etc/x"]' WHEN k % 41 = 2 THEN '["a/../b"]' WHEN k % 41 = 3 THEN '["a/x","a/x"]' WHEN k % 41 = 4 THEN '[5]' ELSE '["art/x.txt"]' END
      || CASE WHEN k % 43 = 0 THEN '' WHEN k % 43 = 1 THEN ',"detail_artifact":"other"' WHEN k % 43 = 2 THEN ',"detail_artifact":"../x"' ELSE ',"detail_artifact":"art/x.txt"' END
      || '}' END
"""
SOURCE = "lower({sha}(CAST(k % 10 AS STRING){bits})) AS sha256, 1000 + k % 10 AS size_bytes, 7 AS page_count"


def shard_texts(spark: SparkSession, d: str) -> DataFrame:
    """``shard, text, sha256, size_bytes, page_count``: an order's lines as the JSON text of a shard, and the source it should be of."""
    lines = tables.table(spark, d, "lineitem").selectExpr(*_split(LINE)).selectExpr("*", f"{RECORD} AS record", f"{OWNED} AS own")
    piece = lambda f: F.array_join(F.transform("pieces", lambda x: x[f]), ",").alias(f"{f}s")
    orders = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "record", "own"))).alias("pieces"), *[F.expr(x) for x in _split(COUNTS)])
    orders = orders.select("k", "n_pages", "n_blocked", "n_uncertain", piece("record"), piece("own").alias("owned"))
    known = orders.selectExpr("*", *_split(SOURCE.format(sha="sha2", bits=", 256")))
    return known.selectExpr("k AS shard", f"{SHARD} AS text", "sha256", "size_bytes", "page_count")


def _split(columns: str) -> list[str]:
    """Expressions of a list; commas inside parentheses and quotes don't part them."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(columns):
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


SHARDS_SQL = f"""
    l AS (SELECT {LINE} FROM lineitem),
    r AS (SELECT *, {RECORD} AS record, {OWNED} AS own FROM l),
    o AS (SELECT k, string_agg(record, ',' ORDER BY n, record, own) AS records, string_agg(own, ',' ORDER BY n, record, own) AS owned, {COUNTS} FROM r GROUP BY k),
    i AS (SELECT *, {SOURCE.format(sha="sha256", bits="")} FROM o),
    shards AS (SELECT k, sha256, size_bytes, page_count, {SHARD} AS x FROM i)
"""
STATUS = "('pending', 'in-progress', 'rebuilt', 'blocked', 'omitted-with-reason')"
#: What DuckDB's own JSON functions find in the same texts.
VALIDATION_SQL = f"""
    WITH {SHARDS_SQL},
    judged AS (SELECT *, coalesce(json_valid(x), false) AND coalesce(json_type(CASE WHEN json_valid(x) THEN x ELSE '0' END), '') = 'OBJECT' AS ok FROM shards),
    v AS (
      SELECT k, sha256, size_bytes, page_count, x, CASE WHEN json_type(x, '$.schema_version') = 'UBIGINT' THEN (x->>'$.schema_version')::BIGINT END AS version,
             json_type(x, '$.source') AS source_type, json_type(x, '$.usage') AS usage_type, json_type(x, '$.worker_summary') AS summary_type,
             CASE WHEN json_type(x, '$.status') = 'VARCHAR' THEN x->>'$.status' END AS status,
             CASE WHEN json_type(x, '$.pages') = 'ARRAY' THEN json_extract(x, '$.pages[*]') END AS pages, CASE WHEN json_type(x, '$.owned_pages') = 'ARRAY' THEN json_extract(x, '$.owned_pages[*]') END AS owned,
             CASE WHEN json_type(x, '$.context_pages') = 'ARRAY' THEN json_extract(x, '$.context_pages[*]') END AS context, CASE WHEN json_type(x, '$.artifacts') = 'ARRAY' THEN json_extract(x, '$.artifacts[*]') END AS artifacts
      FROM (SELECT * FROM judged WHERE ok)),
    rec AS (
      SELECT k, version, i, 'pages[' || i || ']' AS spot, j, json_type(j) = 'OBJECT' AS is_object, CASE WHEN json_type(j, '$.page') = 'UBIGINT' AND (j->>'$.page')::BIGINT > 0 THEN (j->>'$.page')::BIGINT END AS page,
             CASE WHEN json_type(j, '$.status') = 'VARCHAR' THEN j->>'$.status' END AS status
      FROM (SELECT k, version, unnest(range(len(pages))) AS i, unnest(pages) AS j FROM v WHERE pages IS NOT NULL)),
    num AS (
      SELECT k, f, i, CASE WHEN json_type(j) = 'UBIGINT' AND j::BIGINT BETWEEN 1 AND page_count THEN j::BIGINT END AS page
      FROM (SELECT k, page_count, 'owned_pages' AS f, unnest(range(len(owned))) AS i, unnest(owned) AS j FROM v WHERE owned IS NOT NULL
            UNION ALL SELECT k, page_count, 'context_pages', unnest(range(len(context))), unnest(context) FROM v WHERE context IS NOT NULL)),
    own AS (SELECT DISTINCT k, page FROM num WHERE f = 'owned_pages' AND page IS NOT NULL),
    art AS (
      SELECT k, i, CASE WHEN json_type(j) = 'VARCHAR' AND trim(j->>'$') <> '' THEN j->>'$' END AS path FROM (SELECT k, unnest(range(len(artifacts))) AS i, unnest(artifacts) AS j FROM v WHERE artifacts IS NOT NULL)),
    fine AS (SELECT *, NOT (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) AS inside FROM art),
    counted AS (
      SELECT v.k, n.f, n.declared, CASE n.f WHEN 'owned_page_count' THEN coalesce(c.a, 0) WHEN 'blocked_page_count' THEN coalesce(c.b, 0) ELSE coalesce(c.u, 0) END AS actual
      FROM v CROSS JOIN LATERAL (SELECT f, CASE WHEN json_type(x, '$.worker_summary.' || f) = 'UBIGINT' THEN (x->>('$.worker_summary.' || f))::BIGINT END AS declared FROM (VALUES ('owned_page_count'), ('blocked_page_count'), ('uncertain_page_count')) t(f)) n
      LEFT JOIN (SELECT k, count(*) AS a, count(*) FILTER (status = 'blocked') AS b,
                        count(*) FILTER (CASE WHEN version = 2 THEN json_type(j, '$.uncertainty_count') = 'UBIGINT' AND (j->>'$.uncertainty_count')::BIGINT > 0 ELSE coalesce(json_array_length(j, '$.uncertainties'), 0) > 0 END) AS u
                 FROM rec WHERE is_object GROUP BY k) c USING (k)
      WHERE v.summary_type = 'OBJECT'),
    used AS (SELECT k, unnest(json_keys(x, '$.usage')) AS f, x FROM v WHERE usage_type = 'OBJECT'),
    found AS (
      SELECT k, 'json-object' AS rule_id, '' AS detail FROM judged WHERE NOT ok
      UNION ALL SELECT k, 'schema-version', 'schema_version' FROM v WHERE coalesce(version, 0) NOT IN (1, 2)
      UNION ALL SELECT k, 'kind', 'kind' FROM v WHERE x->>'$.kind' <> 'page-ir-shard'
      UNION ALL SELECT k, 'batch-id', 'batch_id' FROM v WHERE json_type(x, '$.batch_id') <> 'VARCHAR' OR NOT regexp_full_match(x->>'$.batch_id', '[A-Za-z0-9][A-Za-z0-9._-]*')
      UNION ALL SELECT k, 'no-pages', 'owned_pages' FROM v WHERE len(owned) = 0
      UNION ALL SELECT k, 'snapshot-digest', 'style_profile_sha256' FROM v WHERE json_type(x, '$.style_profile_sha256') <> 'NULL' AND NOT regexp_full_match(x->>'$.style_profile_sha256', '[0-9a-f]{{64}}')
      UNION ALL SELECT k, 'status', 'status' FROM v WHERE status IS NULL OR status NOT IN {STATUS}
      UNION ALL SELECT k, 'reason', 'reason' FROM v WHERE status IN ('blocked', 'omitted-with-reason') AND coalesce(trim(x->>'$.reason'), '') = ''
      UNION ALL SELECT k, 'next-action', 'next_action' FROM v WHERE status = 'blocked' AND coalesce(trim(x->>'$.next_action'), '') = ''
      UNION ALL SELECT k, 'source-object', 'source' FROM v WHERE source_type <> 'OBJECT'
      UNION ALL SELECT k, 'source-digest', 'source.sha256' FROM v WHERE source_type = 'OBJECT' AND NOT regexp_full_match(x->>'$.source.sha256', '[0-9a-f]{{64}}')
      UNION ALL SELECT k, 'source-size', 'source.size_bytes' FROM v WHERE source_type = 'OBJECT' AND json_type(x, '$.source.size_bytes') <> 'UBIGINT'
      UNION ALL SELECT k, 'source-pages', 'source.page_count' FROM v WHERE source_type = 'OBJECT' AND json_type(x, '$.source.page_count') <> 'UBIGINT'
      UNION ALL SELECT k, 'source-mismatch', 'source' FROM v WHERE source_type = 'OBJECT' AND regexp_full_match(x->>'$.source.sha256', '[0-9a-f]{{64}}') AND json_type(x, '$.source.size_bytes') = 'UBIGINT' AND json_type(x, '$.source.page_count') = 'UBIGINT'
        AND (x->>'$.source.sha256' <> sha256 OR (x->>'$.source.size_bytes')::BIGINT <> size_bytes OR (x->>'$.source.page_count')::BIGINT <> page_count)
      UNION ALL SELECT k, 'page-list', 'owned_pages' FROM v WHERE owned IS NULL
      UNION ALL SELECT k, 'page-list', 'context_pages' FROM v WHERE context IS NULL
      UNION ALL SELECT k, 'page-number', f || '[' || i || ']' FROM num WHERE page IS NULL
      UNION ALL SELECT k, 'repeated-page', f || '[' || i || ']' FROM num WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, f, page ORDER BY i) > 1
      UNION ALL SELECT k, 'record-list', 'pages' FROM v WHERE pages IS NULL
      UNION ALL SELECT k, 'record-object', spot FROM rec WHERE NOT is_object
      UNION ALL SELECT k, 'record-page', spot || '.page' FROM rec WHERE is_object AND page IS NULL
      UNION ALL SELECT k, 'repeated-record', spot || '.page' FROM rec WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, page ORDER BY i) > 1
      UNION ALL SELECT k, 'record-not-owned', spot || '.page' FROM rec ANTI JOIN own USING (k, page) WHERE page IS NOT NULL
      UNION ALL SELECT k, 'route', spot || '.route' FROM rec WHERE is_object AND (json_type(j, '$.route') <> 'VARCHAR' OR trim(j->>'$.route') = '')
      UNION ALL SELECT k, 'page-status', spot || '.status' FROM rec WHERE is_object AND (status IS NULL OR status NOT IN {STATUS})
      UNION ALL SELECT k, 'reason', spot || '.reason' FROM rec WHERE is_object AND status IN ('blocked', 'omitted-with-reason') AND coalesce(trim(j->>'$.reason'), '') = ''
      UNION ALL SELECT k, 'next-action', spot || '.next_action' FROM rec WHERE is_object AND status = 'blocked' AND coalesce(trim(j->>'$.next_action'), '') = ''
      UNION ALL SELECT k, 'page-count', spot || '.' || f FROM rec, (VALUES ('block_count'), ('object_count'), ('continuity_count'), ('uncertainty_count')) t(f) WHERE is_object AND version = 2 AND coalesce(json_type(j, '$.' || f), '') <> 'UBIGINT'
      UNION ALL SELECT k, 'page-array', spot || '.' || f FROM rec, (VALUES ('blocks'), ('objects'), ('continuity'), ('uncertainties')) t(f) WHERE is_object AND version = 1 AND coalesce(json_type(j, '$.' || f), '') <> 'ARRAY'
      UNION ALL SELECT own.k, 'missing-record', own.page::VARCHAR FROM own JOIN v ON v.k = own.k AND v.pages IS NOT NULL ANTI JOIN rec ON rec.k = own.k AND rec.page = own.page
      UNION ALL SELECT k, 'summary-absent', 'worker_summary' FROM v WHERE version = 2 AND coalesce(summary_type, 'NULL') = 'NULL'
      UNION ALL SELECT k, 'summary-object', 'worker_summary' FROM v WHERE summary_type NOT IN ('OBJECT', 'NULL')
      UNION ALL SELECT k, 'summary-text', 'worker_summary.text' FROM v WHERE summary_type = 'OBJECT' AND trim(x->>'$.worker_summary.text') = ''
      UNION ALL SELECT k, 'summary-length', 'worker_summary.text' FROM v WHERE summary_type = 'OBJECT' AND length(x->>'$.worker_summary.text') > 1200
      UNION ALL SELECT k, CASE WHEN declared IS NULL THEN 'summary-count' ELSE 'summary-mismatch' END, 'worker_summary.' || f FROM counted WHERE declared IS DISTINCT FROM actual
      UNION ALL SELECT k, 'usage-object', 'usage' FROM v WHERE usage_type NOT IN ('OBJECT', 'NULL')
      UNION ALL SELECT k, 'usage-field', 'usage.' || f FROM used WHERE f NOT IN ('input_tokens', 'output_tokens', 'cached_input_tokens', 'reasoning_tokens', 'duration_ms', 'retry_count')
      UNION ALL SELECT k, 'usage-count', 'usage.' || f FROM used WHERE f IN ('input_tokens', 'output_tokens', 'cached_input_tokens', 'reasoning_tokens', 'duration_ms', 'retry_count') AND json_type(x, '$.usage.' || f) <> 'UBIGINT'
      UNION ALL SELECT k, 'cached-over-input', 'usage.cached_input_tokens' FROM v WHERE usage_type = 'OBJECT' AND json_type(x, '$.usage.cached_input_tokens') = 'UBIGINT' AND (x->>'$.usage.cached_input_tokens')::BIGINT > (x->>'$.usage.input_tokens')::BIGINT
      UNION ALL SELECT k, 'artifact-list', 'artifacts' FROM v WHERE artifacts IS NULL
      UNION ALL SELECT k, 'artifact-text', 'artifacts[' || i || ']' FROM fine WHERE path IS NULL
      UNION ALL SELECT k, 'artifact-outside', 'artifacts[' || i || ']' FROM fine WHERE NOT inside
      UNION ALL SELECT k, 'repeated-artifact', 'artifacts[' || i || ']' FROM fine WHERE inside QUALIFY row_number() OVER (PARTITION BY k, path ORDER BY i) > 1
      UNION ALL SELECT k, 'detail-text', 'detail_artifact' FROM v WHERE version = 2 AND x->>'$.detail_artifact' IS NULL
      UNION ALL SELECT k, 'detail-outside', 'detail_artifact' FROM v WHERE version = 2 AND list_contains(string_split(x->>'$.detail_artifact', '/'), '..')
      UNION ALL SELECT k, 'detail-not-listed', 'detail_artifact' FROM v WHERE version = 2 AND NOT list_contains(string_split(x->>'$.detail_artifact', '/'), '..') AND NOT EXISTS (FROM fine WHERE fine.k = v.k AND inside AND path = v.x->>'$.detail_artifact'))
    SELECT 'shard' AS entity, k::VARCHAR AS entity_key, rule_id, detail FROM found
"""


@query("shard_validation", VALIDATION_SQL)
def q_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of every shard, with its place."""
    return shard_rules.strict_violations(shard_texts(spark, d))
