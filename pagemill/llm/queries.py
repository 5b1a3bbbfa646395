"""The queries of the entry module for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def vocabulary() -> str:
    """The tokenizer that the queries use; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op01_packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op02_exact_dedup import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op03_suffix_dedup import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return left.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op04_decontamination import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination_digest(found)


def contamination_digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: The conversation that the template's own control strings are tried on.
TRIAL = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op05_chat import format_conversations, read_back

    own = spark.createDataFrame([(-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(turns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op06_toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op07_brown import class_scores

    return class_scores(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op08_line_dedup import drop_recurring_lines

    kept = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op09_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=3, parts=2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op11_bpe import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hashlib import sha256

    from .op12_codes import by_label, compress

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return by_label(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_exact_dedup, op3_suffix_dedup, op4_decontamination, op5_chat, op6_toxicity, op7_brown, op8_line_dedup, op9_simhash, op10_quality, op11_bpe, op12_codes, op13_filter_audit)
}


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Product codes in SQL, a step for each round."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""
        WITH q AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS x FROM q, range({parts}) r(p)),
        book0 AS MATERIALIZED (
          SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
          FROM cut WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT {entries}))"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS MATERIALIZED (SELECT vec_id, p, min({distance} * {entries} + e) AS best FROM cut JOIN book{k} USING (p) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""
        sums{k} AS (
          SELECT p, best % {entries} AS e, i, count(*) AS n, sum(x[i])::BIGINT AS s
          FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM cut JOIN near{k} USING (vec_id, p)) GROUP BY ALL),
        mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{k} GROUP BY p, e),
        book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return (
        ",".join(steps)
        + f"""
        , coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN q USING (vec_id)
    """
    )


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t
    """,
    "op5_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        own AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
               sum(14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')))::BIGINT AS formatted_chars
        FROM own GROUP BY conv_id
    """,
    "op8_line_dedup": r"""
        WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        l AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM raw),
        tok AS (
          SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda t: t <> ''),
                 lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM l),
        lines AS (
          SELECT doc_id, line_no, tokens, len(tokens) AS n, array_to_string(tokens, ' ') AS line,
                 len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM tok WHERE len(tokens) > 0),
        kinds AS (SELECT leaf, line, any_value(tokens) AS tokens, any_value(n) AS n, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY leaf, line),
        inside AS (SELECT *, n // 5 AS d, greatest(n - 3, 0) AS r FROM kinds WHERE n >= 5 AND leaf IN (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1)),
        branches AS (
          SELECT leaf AS branch, line, n_docs FROM inside
          UNION ALL SELECT leaf || chr(1) || s || chr(1) || array_to_string(tokens[4:][(s * r + d) // (d + 1) + 1 : ((s + 1) * r + d) // (d + 1)], ' '), line, n_docs
          FROM (SELECT *, unnest(range(0, d + 1)) AS s FROM inside)),
        forms AS (SELECT branch, line AS form FROM branches QUALIFY row_number() OVER (PARTITION BY branch ORDER BY n_docs DESC, substr(md5(line), 1, 15) DESC) = 1),
        pairs AS (SELECT DISTINCT line, form FROM branches JOIN forms USING (branch) WHERE line <> form),
        alike AS (
          SELECT form, p.line FROM pairs p JOIN inside a ON a.line = p.line JOIN inside b ON b.line = p.form
          WHERE len(list_filter(range(1, a.n + 1), lambda i: a.tokens[i] = b.tokens[i])) * 5 >= 4 * a.n),
        members AS (SELECT form, line FROM alike UNION SELECT form, form FROM alike),
        wide AS (SELECT line FROM members WHERE form IN (SELECT form FROM members JOIN lines USING (line) GROUP BY form HAVING count(DISTINCT doc_id) >= 2)),
        gone AS (SELECT line FROM kinds WHERE n_docs >= 2 UNION SELECT line FROM wide),
        dropped AS (SELECT doc_id, list(DISTINCT line_no) AS nos FROM lines JOIN gone USING (line) GROUP BY doc_id)
        SELECT r.doc_id, len(r.l)::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_dropped,
               sha256(coalesce(array_to_string(list_filter(list_transform(range(0, len(r.l)), lambda i: CASE WHEN nos IS NOT NULL AND list_contains(nos, i) THEN NULL ELSE r.l[i + 1] END), lambda x: x IS NOT NULL), chr(10)), '')) AS kept_sha256
        FROM raw r LEFT JOIN dropped USING (doc_id)
    """,
    "op4_decontamination": r"""
        WITH low AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
          SELECT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (
          SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM low, sizes WHERE len(w) >= size)),
        met AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x USING (size, win)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM met) GROUP BY doc_id),
        named AS (
          SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op12_codes": codes_sql(),
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
        w AS (
          SELECT doc_id, part, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS words, min(doc_id) OVER (PARTITION BY x) AS least FROM d),
        m AS (
          SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                 + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::INT
                 + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
        said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        cells AS (
          SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
          FROM m LEFT JOIN said USING (doc_id) GROUP BY part, mask),
        f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (
          SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        steps AS (
          SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[:k])::INT - bits[k] AS before FROM orders, range(1, 6) r(k)),
        counted AS (
          SELECT part, filter_order, step::INT AS step, bit,
                 sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                 sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                 sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                 sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                 sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                 sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM cells, steps GROUP BY ALL)
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
    """,
}
