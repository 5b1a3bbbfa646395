"""Findings in build logs and sources, dependencies by root, and the reduction of stages to an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.files import RESERVED_FOLDERS as SKIPPED_FOLDERS
from . import ordered

# Fixed values: (category, pattern) in order of precedence, errors before warnings.
ERRORS = (
    ("missing-character", r"Missing character: There is no "),
    ("undefined-control-sequence", r"Undefined control sequence"),
    ("undefined-citation", r"(?i)Citation .* undefined"),
    ("undefined-reference", r"(?i)Reference .* undefined"),
    ("undefined-reference", r"There were undefined references"),
    ("rerun-required", r"Rerun to get cross-references right"),
    ("package-error", r"Package .* Error"),
    ("fontspec-error", r"(?i)fontspec.*Error"),
    ("missing-file", r"File .* not found"),
    ("fatal-error", r"Fatal error|Emergency stop|No pages of output"),
)
WARNINGS = (
    ("font-warning", r"LaTeX Font Warning"),
    ("overfull-hbox", r"Overfull \\hbox"),
    ("overfull-vbox", r"Overfull \\vbox"),
    ("underfull-box", r"Underfull \\[hv]box"),
)
ARTIFACTS = r"(?i)\\pdfglyph\s*\{|extracteddisplay|TODO[\s_-]*math|unresolved[\s_-]+glyph|MATH_PLACEHOLDER|raw[\s_-]+glyph\s*:|math[\s_-]*placeholder|Replace this scaffold with semantic content"
SHELL_ESCAPE = r"(?i)\\(?:immediate\s*)?write18\b|\\input\s*\|"
COMPLEX_BUILD = r"\\(?:addbibresource|bibliography|makeindex|makeglossaries)\b"
REFERENCE = r"\\(input|include|includegraphics|addbibresource|bibliography|bibliographystyle)(?:\s*\[[^\]]*\])?\s*\{([^{}]+)\}"


def first_match(line: Column, errors=ERRORS, warnings=WARNINGS) -> Column:
    """Severity and category of the first pattern that a line matches, else null."""
    out = None
    for severity, patterns in (("ERROR", errors), ("WARN", warnings)):
        for category, pattern in patterns:
            value = F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))
            out = F.when(line.rlike(pattern), value) if out is None else out.when(line.rlike(pattern), value)
    return out


def log_findings(lines: DataFrame, source: str, errors=ERRORS, warnings=WARNINGS) -> DataFrame:
    """``severity, category, message, source`` of matching lines (``line_no, line``), each once."""
    rows = lines.withColumn("__m", first_match(F.col("line"), errors, warnings)).where("__m is not null")
    rows = rows.select("__m.severity", "__m.category", F.trim("line").alias("message"), F.concat_ws(":", F.col(source).cast("string"), F.col("line_no").cast("string")).alias("source"))
    return deduplicated(rows)


def deduplicated(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["severity", "category", "message", "source"])


def finding_order() -> list[Column]:
    """Errors first, then by category and message."""
    return [F.col("severity") != "ERROR", F.col("category"), F.col("message"), F.col("source")]


def finding_counts(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return findings.groupBy(*(keys or [])).agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))


def artifact_lines(lines: DataFrame, pattern: str = ARTIFACTS) -> DataFrame:
    """Lines that have leftovers of an unfinished document."""
    return lines.where(F.col("line").rlike(pattern))


def source_checks(lines: DataFrame) -> DataFrame:
    """Lines outside comments that run commands, or that need more than one build tool."""
    code = tx.strip_tex_comment(F.col("line"))
    return lines.select("*", code.rlike(SHELL_ESCAPE).alias("shell_escape"), code.rlike(COMPLEX_BUILD).alias("complex_build")).where("shell_escape or complex_build")


def references(lines: DataFrame) -> DataFrame:
    """Commands that name files, and the names; one ``bibliography`` may name several. Names made by macros are left out."""
    code = tx.strip_tex_comment(F.col("line"))
    both = F.arrays_zip(F.regexp_extract_all(code, F.lit(REFERENCE), 1).alias("command"), F.regexp_extract_all(code, F.lit(REFERENCE), 2).alias("value"))
    rows = lines.select(*[c for c in lines.columns if c != "line"], F.explode(both).alias("r")).select(*[c for c in lines.columns if c != "line"], F.col("r.command").alias("command"), F.explode(F.when(F.col("r.command") == "bibliography", F.split("r.value", ",")).otherwise(F.array("r.value"))).alias("value"))
    return rows.withColumn("value", F.trim("value")).where(~F.col("value").contains("\\") & ~F.col("value").contains("#") & (F.col("value") != ""))


def remap_prefix(findings: DataFrame, build: str, project: str) -> DataFrame:
    return findings.withColumn("message", F.replace("message", F.lit(build), F.lit(project)))


def text_files(files: DataFrame) -> DataFrame:
    """Files without a NUL among the first 8192 bytes, outside the folders of outputs."""
    head = F.substring(F.col("content"), 1, 8192)
    top = F.element_at(F.split("relative", "/"), 1)
    return files.where((F.position(F.lit(b"\x00"), head) == 0) & ~top.isin(*SKIPPED_FOLDERS))


def dependency_categories(paths: DataFrame, roots: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Each path with the first category of ``roots (category, folder)`` that it lies in, else external.

    The roots are a fixed few, so they are a CASE, not a join.
    """
    out = None
    for category, folder in roots:
        test = tx.is_inside(F.col(path), F.lit(folder))
        out = F.when(test, category) if out is None else out.when(test, category)
    return paths.withColumn("category", out.otherwise("external") if out is not None else F.lit("external"))


def dependency_categories_by_table(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """The same with a table of any size, ``priority, category, folder``: a path's ancestors are joined by equality."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbs = F.array_contains(parts, "..")
    steps = paths.select(F.col(path).alias("__p")).distinct().withColumn(path, F.col("__p")).where(~climbs).select("__p", F.explode(ancestors).alias("folder"))
    best = steps.join(roots.withColumn("folder", F.regexp_replace("folder", "/+$", "")), "folder").groupBy("__p").agg(F.min_by("category", "priority").alias("__c"))
    return paths.join(best, F.col(path) == F.col("__p"), "left").withColumn("category", F.coalesce("__c", F.lit("external"))).drop("__p", "__c")


def dependency_report(classified: DataFrame, categories: list[str], path: str = "path") -> DataFrame:
    """Number of different paths, the first and the last of each category; categories without any have a row too."""
    spark = classified.sparkSession
    every = spark.createDataFrame([(c,) for c in categories], "category string")
    found = classified.select("category", path).distinct().groupBy("category").agg(F.count("*").alias("paths"), F.min(path).alias("first_path"), F.max(path).alias("last_path"))
    return every.join(found, "category", "left").withColumn("paths", F.coalesce("paths", F.lit(0).cast("long"))).withColumn("first_path", F.coalesce("first_path", F.lit("none"))).withColumn("last_path", F.coalesce("last_path", F.lit("none")))


def text_equality(a: DataFrame, b: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Whether two extractions of a document agree but for white space; what one lacks disagrees."""
    left, right = a.select(key, tx.squeeze(F.col(text)).alias("__a")), b.select(key, tx.squeeze(F.col(text)).alias("__b"))
    return left.join(right, key, "full_outer").select(key, F.col("__a").eqNullSafe(F.col("__b")).alias("equal"))


def reduce_stages(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Stages ``stage_no, status`` up to the first FAIL: how many ran, the exit code and the outcome.

    FAIL gives 1, else INCOMPLETE 2, else 0. Grouped sums suffice: the first failure is a minimum, and what stood
    before it is counted by joining it back.
    """
    fail = stages.groupBy(*keys).agg(F.min(F.when(F.col("status") == "FAIL", F.col("stage_no"))).alias("failed_at"))
    rows = stages.join(fail, keys).where(F.col("failed_at").isNull() | (F.col("stage_no") <= F.col("failed_at")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("stages_run"), F.max("failed_at").alias("failed_at"), F.bool_or(F.col("status") == "INCOMPLETE").alias("__open"))
    code = F.when(F.col("failed_at").isNotNull(), 1).when(F.col("__open"), 2).otherwise(0)
    return out.select(*keys, "stages_run", "failed_at", code.alias("exit_code"))


def fill_forward(rows: DataFrame, keys: list[str], order: list[str], marker: Column, name: str, chunk: int = ordered.CHUNK) -> DataFrame:
    """The last marker (not null) at or before each row; one key may hold most of the rows."""
    return ordered.last_value(ordered.with_chunk(rows, keys, order, chunk), keys, order, marker, name).drop("__chunk")
