"""Page texts from files: one file with form feeds for each source, or else one file for each page.

    root/<source>.txt               all pages, parted by form feeds
    root/<source>/page-001.txt      a page, where the form feeds don't give as many pages as the source has

The files are read by Spark's own binary reader: it plans the partitions, lists without contents where only names and sizes are asked
for, and works with any store. A file's digest is taken from the very bytes that its pages come from; ``changed`` reads
the digests again afterwards, so that a source that was written meanwhile is told.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.settle import settled
from .files import form_feed_pages, unusable_separators


@dataclass(frozen=True)
class PageTexts:
    """``pages (source_id, page, text)``, ``digests (path, source_id, sha256, size_bytes)`` of what was read, and ``problems (source_id, rule_id, detail)``; sources with problems have no pages."""

    pages: DataFrame
    digests: DataFrame
    problems: DataFrame


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative, content`` of text files below ``root``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    folder = root.split("://")[-1].strip("/")  # stands in every path, after its scheme
    begin = F.position(F.lit(folder + "/"), F.col("path")) + len(folder) + 1
    return rows.select("path", F.substring("path", begin, F.length("path")).alias("relative"), "content")


def digested(rows: DataFrame) -> DataFrame:
    source = F.regexp_extract("relative", r"^(.*?)(?:/page-\d{3,})?\.txt$", 1)
    page = F.nullif(F.regexp_extract("relative", r"/page-(\d{3,})\.txt$", 1), F.lit("")).cast("int")
    return rows.select("path", source.alias("source_id"), page.alias("page"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def read(spark: SparkSession, root: str, counts: DataFrame) -> PageTexts:
    """The pages of all sources of ``counts (source_id, page_count)``, by form feeds, else by page files."""
    # what is read is written once: pages and digests are of the same bytes
    rows = settled(digested(listing(spark, root)))
    whole, single = rows.where("page IS NULL"), rows.where("page IS NOT NULL")
    keyed = counts.select(F.col("source_id"), "page_count")
    texts = whole.where("text IS NOT NULL").select("source_id", "text")
    by_feed = form_feed_pages(texts, keyed, "source_id")
    rest = unusable_separators(texts, keyed, "source_id").unionByName(keyed.join(texts.select("source_id"), "source_id", "left_anti").select("source_id"))
    wanted = keyed.join(rest.distinct(), "source_id")
    by_file = single.join(wanted, "source_id")
    beyond = by_file.where("page < 1 OR page > page_count").select("source_id", F.lit("unexpected-page").alias("rule_id"), F.col("page").cast("string").alias("detail"))
    empty = by_file.where(tx.is_blank(F.col("text"))).select("source_id", F.lit("empty-page").alias("rule_id"), F.col("page").cast("string").alias("detail"))
    found = by_file.where("page BETWEEN 1 AND page_count").groupBy("source_id").agg(F.count_distinct("page").alias("n"))
    lost = wanted.join(found, "source_id", "left").where("coalesce(n, 0) < page_count").select("source_id", F.lit("missing-pages").alias("rule_id"), (F.col("page_count") - F.coalesce("n", F.lit(0))).cast("string").alias("detail"))
    problems = settled(beyond.unionByName(empty).unionByName(lost))
    pages = by_feed.select("source_id", "page", "text").unionByName(by_file.join(problems.select("source_id").distinct(), "source_id", "left_anti").select("source_id", "page", "text"))
    return PageTexts(pages, rows.select("path", "source_id", "sha256", "size_bytes"), problems)


def changed(spark: SparkSession, root: str, before: DataFrame) -> DataFrame:
    """``source_id, rule_id, detail`` of files that aren't what they were when they were read."""
    now = digested(listing(spark, root)).select("path", F.col("source_id").alias("__source"), F.col("sha256").alias("__sha"), F.lit(True).alias("__now"))
    both = before.withColumn("__then", F.lit(True)).join(now, "path", "full_outer")
    rule = F.when(F.col("__now").isNull(), "removed-while-read").when(F.col("__then").isNull(), "added-while-read").when(F.col("sha256") != F.col("__sha"), "changed-while-read")
    return both.select(F.coalesce("source_id", "__source").alias("source_id"), rule.alias("rule_id"), F.col("path").alias("detail")).where("rule_id IS NOT NULL")


def stable(pages: PageTexts, spark: SparkSession, root: str) -> PageTexts:
    """The same without the pages of sources whose files changed since; those are problems too. The pages are written before the files are looked at again."""
    kept = settled(pages.pages)
    moved = settled(changed(spark, root, pages.digests))
    return PageTexts(kept.join(moved.select("source_id").distinct(), "source_id", "left_anti"), pages.digests, pages.problems.unionByName(moved))


def write_form_feeds(pages: DataFrame, folder: str) -> None:
    """``source_id, page, text`` as one text file for each source in folders of its own (``source_id=...``), pages parted by form feeds.

    A source's text is one row, as it is one file.
    """
    one = pages.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\f").alias("value"))
    one.write.partitionBy("source_id").option("lineSep", "\f").text(folder)
