"""Files as tables: page texts, identities, ledgers and shards in JSON, logs, sources, rasters, templates.

Every reader takes paths or globs in any store that Spark reads, and explicit schemas.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

SOURCE = "STRUCT<path STRING, sha256 STRING, size_bytes BIGINT, page_count INT>"
USAGE = "STRUCT<input_tokens BIGINT, output_tokens BIGINT, cached_input_tokens BIGINT, reasoning_tokens BIGINT, duration_ms BIGINT, retry_count BIGINT>"
PAGE = (
    "STRUCT<page INT, route STRING, status STRING, reason STRING, next_action STRING, blocks ARRAY<STRING>, objects ARRAY<STRING>, continuity ARRAY<STRING>, uncertainties ARRAY<STRING>, "
    "block_count BIGINT, object_count BIGINT, continuity_count BIGINT, uncertainty_count BIGINT>"
)
SHARD = (
    f"schema_version INT, kind STRING, batch_id STRING, source {SOURCE}, owned_pages ARRAY<INT>, context_pages ARRAY<INT>, style_profile_sha256 STRING, document_ir_sha256 STRING, "
    f"status STRING, reason STRING, next_action STRING, pages ARRAY<{PAGE}>, artifacts ARRAY<STRING>, detail_artifact STRING, "
    "worker_summary STRUCT<text STRING, owned_page_count BIGINT, blocked_page_count BIGINT, uncertain_page_count BIGINT>"
)
LEDGER = (
    f"schema_version INT, source {SOURCE}, context STRUCT<style_profile_sha256 STRING, document_ir_sha256 STRING>, "
    f"batches ARRAY<STRUCT<batch_id STRING, owned_pages ARRAY<INT>, context_pages ARRAY<INT>, shard STRING, shard_sha256 STRING, artifacts ARRAY<STRUCT<path STRING, sha256 STRING>>, status STRING, attempt INT, merged_at STRING, usage {USAGE}>>"
)
EVIDENCE = f"schema_version INT, pdf {SOURCE}, pages ARRAY<INT>, page_records MAP<STRING, STRUCT<page INT, file STRING, sha256 STRING, dpi INT, renderer STRING, layout BOOLEAN>>"

# Endings of source files, and folders of outputs.
SOURCE_SUFFIXES = (".bbx", ".bib", ".cbx", ".cfg", ".clo", ".cls", ".def", ".dtx", ".fd", ".inc", ".lbx", ".ldf", ".ltx", ".pgf", ".sty", ".tex", ".tikz")
RESERVED_FOLDERS = ("logs", "evidence", "transcripts")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def form_feed_pages(texts: DataFrame, counts: DataFrame, key: str = "path") -> DataFrame:
    """Pages of texts that form feeds part; blank pages at the end are dropped while there are more than ``counts (key, page_count)`` says.

    Sources whose number of pages then differs are left out, see ``unusable_separators``.
    """
    rows = _trimmed(texts, counts, key).where(F.size("__pages") == F.col("page_count"))
    return rows.select(key, F.posexplode("__pages").alias("p", "text")).select(F.col(key).alias("source_id"), (F.col("p") + 1).alias("page"), "text")


def unusable_separators(texts: DataFrame, counts: DataFrame, key: str = "path") -> DataFrame:
    """Sources that need page-by-page files instead."""
    return _trimmed(texts, counts, key).where(F.size("__pages") != F.col("page_count")).select(F.col(key).alias("source_id"))


def _trimmed(texts: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    parts = F.split("text", "\f")
    full = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda p: ~tx.is_blank(p)), True).cast("int"), F.size(parts) + 1) + 1
    keep = F.least(F.size(parts), F.greatest(F.col("page_count"), full))
    keep = F.when(F.exists(parts, lambda p: ~tx.is_blank(p)), keep).otherwise(F.least(F.size(parts), F.col("page_count")))
    return texts.join(counts, key).withColumn("__pages", F.slice(parts, 1, F.greatest(F.lit(1), keep)))


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, page, text`` of one file per page, named page-001 and so on; ``empty`` marks files without text."""
    rows = whole_texts(spark, path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.regexp_extract("path", r"page-(\d{3,})\.[^/.]+$", 1).cast("int").alias("page"), "text", (F.length("text") == 0).alias("empty"))


def source_identities(spark: SparkSession, path: str, page_counts: DataFrame | None = None) -> DataFrame:
    """``path, sha256, size_bytes, is_pdf`` (and ``page_count``, joined by path); the header must stand in the first 1024 bytes."""
    rows = spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"),
        (F.position(F.lit(b"%PDF-"), F.substring("content", 1, 1024)) > 0).alias("is_pdf"),
    )
    return rows if page_counts is None else rows.join(page_counts, "path", "left")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows; a file that isn't an object of this shape fails the query."""
    doc = spark.read.schema(LEDGER).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select("source", "context", F.explode_outer("batches").alias("b")).where("b is not null").select("source", "context", "b.*")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards of both versions, one row a file, with the file's digest, its usage as text and typed, and what could not be parsed."""
    raw = whole_texts(spark, path)
    parsed = F.from_json("text", f"{SHARD}, usage {USAGE}, _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.select(F.col("path").alias("shard"), F.sha2(F.col("text").cast("binary"), 256).alias("shard_sha256"), F.get_json_object("text", "$.usage").alias("usage_json"), parsed.alias("s"))
    return rows.select("shard", "shard_sha256", "usage_json", "s.*")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """``path, key, page, ...`` page records of evidence manifests."""
    doc = spark.read.schema(EVIDENCE).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), "pdf", "pages", F.explode_outer("page_records").alias("key", "r"))
    return doc.select("path", "pdf", "pages", "key", "r.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of logs; no files give no rows."""
    return whole_texts(spark, path).select("path", F.posexplode(tx.lines(F.col("text"))).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def source_files(spark: SparkSession, root: str, suffixes=SOURCE_SUFFIXES) -> DataFrame:
    """``path, relative, content`` of source files below a folder, but for the folders of outputs."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    relative = F.element_at(F.split("path", base.replace("\\", "\\\\").replace(".", "\\.").removeprefix("file://"), 2), -1)
    return rows.select("path", relative.alias("relative"), "content").where(tx.suffix(F.col("path")).isin(*suffixes) & ~F.element_at(F.split("relative", "/"), 1).isin(*RESERVED_FOLDERS))


def recorder_paths(lines: DataFrame, project: str) -> DataFrame:
    """``kind (INPUT or OUTPUT), path`` of a build recorder's lines; relative paths are the project's."""
    kind, raw = F.substring_index("line", " ", 1), F.trim(F.regexp_replace("line", "^(INPUT|OUTPUT) ", ""))
    rows = lines.where(F.col("line").rlike("^(INPUT|OUTPUT) ") & (raw != ""))
    path = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(project.rstrip("/") + "/"), F.regexp_replace(raw, r"^\./", "")))
    return rows.select(kind.alias("kind"), path.alias("path")).distinct()


# How logs of auxiliary programs name what they read.
AUXILIARY_INPUTS = (r"^(?:The style file|Database file #[0-9]+):\s*(.+?)\s*$", r"Found .*?(?:data source|control file) ['\"]([^'\"]+)['\"]", r"Scanning (?:input|style) file\s+(.+?)\.\.\.")


def auxiliary_inputs(lines: DataFrame) -> DataFrame:
    """``path, value`` of files that logs of auxiliary programs name, by the first pattern that matches."""
    value = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in AUXILIARY_INPUTS])
    return lines.select("path", F.regexp_replace(F.trim(value), "^['\"]+|['\"]+$", "").alias("value")).where("value is not null and value <> ''").distinct()


#: Stands for the folder of the file that names another.
BESIDE = ""


def resolve_inputs(values: DataFrame, present: DataFrame, project: str, roots: list[str] | None = None, lookups: DataFrame | None = None) -> DataFrame:
    """``path, value, resolved, found_in``: where the files are that ``values (path, value)`` name.

    Tried in order: the ``roots`` (``BESIDE`` is the folder of ``path``; by default that and the project), then ``lookups (name, found)``, a table of
    names that a search has found; the first that is there. Absolute names are taken as they are. A name that is nowhere is the project's, with null in ``found_in``.
    All places are tried by one join; any number of roots makes no further one.
    """
    roots = [BESIDE, project] if roots is None else roots
    folder = F.regexp_replace("path", "/[^/]*$", "")
    under = lambda r: tx.normal_path(F.concat_ws("/", folder if r == BESIDE else F.lit(r.rstrip("/")), F.col("value")))
    tries = [F.struct(F.lit(i).alias("rank"), F.lit("file").alias("kind"), under(r).alias("name"), F.lit("beside" if r == BESIDE else r).alias("root")) for i, r in enumerate(roots)]
    tries.append(F.struct(F.lit(len(roots)).alias("rank"), F.lit("name").alias("kind"), F.col("value").alias("name"), F.lit("lookup").alias("root")))
    named = values.select("path", "value").distinct()
    relative = named.where(~F.col("value").startswith("/"))
    there = present.select(F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("found")).distinct()
    if lookups is not None:
        there = there.unionByName(lookups.groupBy("name").agg(F.min("found").alias("found")).select(F.lit("name").alias("kind"), "name", "found"))
    asked = relative.select("path", "value", F.explode(F.array(*tries)).alias("t")).select("path", "value", "t.*")
    hit = asked.join(there, ["kind", "name"]).groupBy("path", "value").agg(F.min(F.struct("rank", "found", "root")).alias("best"))
    out = named.join(hit, ["path", "value"], "left")
    whole = F.col("value").startswith("/")
    return out.select("path", "value", F.when(whole, tx.normal_path(F.col("value"))).otherwise(F.coalesce("best.found", under(project))).alias("resolved"), F.when(whole, "absolute").otherwise(F.col("best.root")).alias("found_in"))


def parse_pgm(data: bytes) -> tuple[np.ndarray | None, int | None, str | None]:
    """Samples, maximum and error of a P2 or P5 image; two bytes a sample are big-endian."""
    blank = rb"(?:[ \t\r\n]|#[^\n]*(?:\n|\Z))*"
    head = re.match(blank + rb"(P[25])" + (rb"[ \t\r\n]" + blank + rb"(\d+)(?=[ \t\r\n])") * 3, data)
    if not head:
        return None, None, "header"
    width, height, top = (int(head[k]) for k in (2, 3, 4))
    if not (width and height and 0 < top < 65536):
        return None, None, "dimensions"
    n, body = width * height, data[head.end() :]
    if head[1] == b"P2":
        words = re.sub(rb"#[^\n]*", b"", body).split()[:n]
        if len(words) < n or not all(w.isdigit() for w in words):
            return None, None, "samples"
        return np.array(words, np.int64).astype(np.int32), top, None
    body = body[2 if body[:2] == b"\r\n" else 1 :]
    wide = 1 if top < 256 else 2
    if len(body) < n * wide:
        return None, None, "truncated"
    return np.frombuffer(body[: n * wide], ">u2" if wide == 2 else "u1").astype(np.int32), top, None


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """``path, samples, maximum, error`` of portable graymaps."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # an image at a time: a batch may hold thousands
                samples, top, error = parse_pgm(batch.column(1)[k].as_py())
                own = pa.array([None], pa.list_(pa.int32())) if samples is None else pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], own, pa.array([top], pa.int32()), pa.array([error], pa.string())], ["path", "samples", "maximum", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, samples array<int>, maximum int, error string")


def read_rules(spark: SparkSession, contract: str | dict) -> tuple[DataFrame, DataFrame]:
    """File rules and gate rules of a contract (its text, or parsed): ``path_rules`` and ``gate_rules``."""
    from ..operators.rules import rule_table

    doc = json.loads(contract) if isinstance(contract, str) else contract
    rows = lambda key, what: tuple((r["id"], r.get("when", {}), r[what]) for r in doc[key])
    return rule_table(spark, rows("path_rules", "require_files")), rule_table(spark, rows("gate_rules", "require_gates"))
