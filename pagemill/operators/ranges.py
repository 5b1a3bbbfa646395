"""Page selections and contiguous ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

TOKEN = r"^\s*([1-9][0-9]*)\s*(?:-\s*([1-9][0-9]*)\s*)?$"


def selection_tokens(selection: Column) -> Column:
    """``1,3,5-8`` as structs of first and last page; a malformed token has nulls."""
    def one(t: Column) -> Column:
        a, b = F.regexp_extract(t, TOKEN, 1), F.regexp_extract(t, TOKEN, 2)
        first = F.when(t.rlike(TOKEN), a.try_cast("bigint"))
        return F.struct(first.alias("first"), F.when(t.rlike(TOKEN), F.when(b == "", first).otherwise(b.try_cast("bigint"))).alias("last"))
    return F.transform(F.split(selection, ","), one)


def selected_pages(requests: DataFrame) -> DataFrame:
    """Pages of ``request_id, selection, page_count``, each once; requests with violations give none."""
    bad = selection_violations(requests).select("request_id").distinct()
    rows = requests.join(bad, "request_id", "left_anti").select("request_id", F.explode(selection_tokens(F.col("selection"))).alias("t"))
    return rows.select("request_id", F.explode(F.sequence("t.first", "t.last")).alias("page")).distinct().withColumn("page", F.col("page").cast("int"))


def sweep(ranges: DataFrame, key: str, chunk: int = ordered.CHUNK) -> DataFrame:
    """``key, pos, change, depth`` where the number of ``ranges (key, first, last)`` that cover a page changes.

    A range's work doesn't depend on its length: its ends are two events, those of one place are added up, and the depth
    is their running sum. ``__chunk`` is left for further running values.
    """
    begin = ranges.select(key, F.col("first").cast("bigint").alias("pos"), F.lit(1).alias("change"))
    end = ranges.select(key, (F.col("last") + 1).cast("bigint").alias("pos"), F.lit(-1).alias("change"))
    events = begin.unionByName(end).groupBy(key, "pos").agg(F.sum("change").alias("change")).where("change <> 0")
    return ordered.running_sum(ordered.with_chunk(events, [key], ["pos"], chunk), [key], ["pos"], F.col("change"), "depth")


def merged_ranges(ranges: DataFrame, key: str, chunk: int = ordered.CHUNK) -> DataFrame:
    """``key, first_page, last_page``: the union of ranges as disjoint ones that don't touch, however long they are."""
    # depth leaves zero and comes back to it in turns: what lies between is one range
    edges = sweep(ranges, key, chunk).where("depth = 0 OR depth = change")
    edges = ordered.previous(edges, [key], ["pos"], F.col("pos"), "came")
    return edges.where("depth = 0").select(key, F.col("came").alias("first_page"), (F.col("pos") - 1).alias("last_page"))


def range_depths(ranges: DataFrame, key: str, chunk: int = ordered.CHUNK) -> DataFrame:
    """``key, first_page, last_page, depth``: how often the pages are named, as ranges of one depth; pages that aren't named are left out."""
    edges = ordered.previous(sweep(ranges, key, chunk), [key], ["pos"], F.col("pos"), "came")
    return edges.where("came IS NOT NULL AND depth <> change").select(key, F.col("came").alias("first_page"), (F.col("pos") - 1).alias("last_page"), (F.col("depth") - F.col("change")).cast("long").alias("depth"))


def selection_ranges(requests: DataFrame) -> DataFrame:
    """``request_id, first, last`` of the tokens of sound requests: a row for each token, not for each page."""
    bad = selection_violations(requests).select("request_id").distinct()
    return requests.join(bad, "request_id", "left_anti").select("request_id", F.explode(selection_tokens(F.col("selection"))).alias("t")).select("request_id", "t.first", "t.last")


def selected_ranges(requests: DataFrame, chunk: int = ordered.CHUNK) -> DataFrame:
    """``request_id, first_page, last_page``: what ``selected_pages`` gives, as disjoint ranges; ``1-1000000000`` is one row."""
    return merged_ranges(selection_ranges(requests), "request_id", chunk)


def selection_violations(requests: DataFrame) -> DataFrame:
    """``request_id, rule_id`` of malformed tokens, ranges that run backward, and pages beyond the last."""
    rows = requests.select("request_id", "page_count", F.explode(selection_tokens(F.col("selection"))).alias("t"))
    rule = F.when(F.col("t.first").isNull() | F.col("t.last").isNull(), "malformed-token").when(F.col("t.first") > F.col("t.last"), "reversed-range").when(F.col("t.last") > F.col("page_count"), "page-out-of-bounds")
    return rows.select("request_id", rule.alias("rule_id")).where("rule_id is not null").distinct()


def contiguous_ranges(pages: DataFrame, keys: list[str], page: str = "page", chunk: int = ordered.CHUNK) -> DataFrame:
    """First and last page and number of pages of each run of neighbouring pages."""
    df = pages.select(*keys, F.col(page).alias("page")).distinct()
    df = ordered.ordinal(ordered.with_chunk(df, keys, ["page"], chunk), keys, ["page"], "__n")
    df = df.withColumn("__island", F.col("page") - F.col("__n"))
    return df.groupBy(*keys, "__island").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages")).drop("__island")


def representative_pages(pages: DataFrame, keys: list[str], page: str = "page", chunk: int = ordered.CHUNK) -> DataFrame:
    """The first, the middle and the last page of each key."""
    df = ordered.ordinal(ordered.with_chunk(pages, keys, [page], chunk), keys, [page], "__n").drop("__chunk")
    counts = pages.groupBy(*keys).agg(F.count("*").alias("__count"))
    df = df.join(counts, keys)
    return df.where((F.col("__n") == 1) | (F.col("__n") == F.col("__count")) | (F.col("__n") == F.floor((F.col("__count") + 1) / 2))).drop("__n", "__count")


def tail(rows: DataFrame, keys: list[str], order: str, n: int, chunk: int = ordered.CHUNK) -> DataFrame:
    """The last n rows of each key."""
    df = ordered.ordinal(ordered.with_chunk(rows, keys, [order], chunk), keys, [order], "__n").drop("__chunk")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__count"))
    return df.join(counts, keys).where(F.col("__n") > F.col("__count") - n).drop("__n", "__count")
