"""Ways to write results: committed as a whole, appended, created once, or by replaced partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import finding_counts
from .commits import CommitLog


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A new version of a table at its old path.

    The rows are written beside it first, so a write that fails leaves the table as it was, and they may be read from the
    table itself. Then two renames swap the folders; a crash between them leaves the old files beside the path (``.old-``).
    Where readers must never see that, or several tables change together, use a ``CommitLog``.
    """
    spark = df.sparkSession
    jvm, mark = spark._jvm, uuid.uuid4().hex
    here, new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{end}") for end in ("", f".new-{mark}", f".old-{mark}"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.format(fmt).save(new.toString())
    except Exception:
        fs.delete(new, True)
        raise
    there = fs.exists(here)
    if there and not fs.rename(here, old) or not fs.rename(new, here):
        raise OSError(f"could not move the new files to {path}; the old ones are there or at {old.toString()}")
    if there:
        fs.delete(old, True)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def create(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Written only if nothing is there."""
    df.write.mode("ignore").format(fmt).save(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that ``df`` has rows of are replaced; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def staged(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Several tables as one named version, by a commit: all change together, and a failed write changes nothing."""
    CommitLog(spark, root).commit(tables, note=version)
    return version


def current_version(spark: SparkSession, root: str) -> str:
    return CommitLog(spark, root).state()["note"]


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text; fields without a value are left out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def report_lines(df: DataFrame, key: str) -> DataFrame:
    """``key, line, value``: each row as lines ``name: value`` in the order of its columns; a null is ``none``."""
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in df.columns])
    return df.select(key, F.posexplode(lines).alias("line", "value"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON beside their counts."""
    replace(findings, f"{path}/findings", "json")
    replace(finding_counts(findings), f"{path}/counts", "json")


def clean_copy(files: DataFrame, outputs: DataFrame, path: str = "relative") -> DataFrame:
    """Files to carry over: neither recorded outputs nor in the folders of outputs."""
    from .files import RESERVED_FOLDERS

    return files.where(~F.element_at(F.split(path, "/"), 1).isin(*RESERVED_FOLDERS)).join(outputs.select(path), path, "left_anti")
