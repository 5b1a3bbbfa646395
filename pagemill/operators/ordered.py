"""Running values over the rows of a key in order, when one key may hold most of the rows.

Rows are dealt to chunks: ranges of the order (keys first), cut so that each holds about the same number of *rows*,
whatever the order's values are. Windows run inside chunks, and a second window runs over one summary row of each
chunk of a key, so no task gets a whole key. Borders come from a sample, so the dealt rows are written before they are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

#: Rows of a chunk.
CHUNK = 1 << 16


def with_chunk(df: DataFrame, keys: list[str], order: list[str], rows: int = CHUNK, ready: bool = False) -> DataFrame:
    """``df`` with ``__chunk``, the number of the range of (keys, order) that a row lies in.

    Rows that agree in keys and order share a chunk. ``df`` is read three times (counted, sampled, dealt), so it is
    written first unless it is ``ready``: written already, or as cheap as a scan.
    """
    df = df if ready else settled(df)
    chunks = max(1, -(-df.count() // rows))
    return settled(df.repartitionByRange(chunks, *keys, *order).withColumn("__chunk", F.spark_partition_id().cast("long")))


def _carry(df: DataFrame, keys: list[str], summary: list[Column], carried: list[tuple[str, Column]]) -> DataFrame:
    """Join to each row what the chunks before its own add up to."""
    per = df.groupBy(*keys, "__chunk").agg(*summary)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__chunk", *[c.over(before).alias(n) for n, c in carried])
    left, right = df.alias("l"), per.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__chunk"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return left.join(right, on).select("l.*", *[f"r.{n}" for n, _ in carried])


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 within a key."""
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    df = df.withColumn("__inner", F.row_number().over(inside))
    df = _carry(df, keys, [F.count("*").alias("__c")], [("__before", F.sum("__c"))])
    return df.withColumn(name, (F.col("__inner") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__inner", "__before")


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The value (not null) of the row before."""
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    df = df.withColumn("__v", value).withColumn("__lag", F.lag("__v").over(inside))
    df = _carry(df, keys, [F.max_by("__v", F.struct(*order)).alias("__last")], [("__before", F.last("__last"))])
    return df.withColumn(name, F.coalesce("__lag", "__before")).drop("__v", "__lag", "__before")


def last_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, at or before each row."""
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__v", value).withColumn("__own", F.last("__v", ignorenulls=True).over(inside))
    last = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__last")
    df = _carry(df, keys, [last], [("__before", F.last("__last", ignorenulls=True))])
    return df.withColumn(name, F.coalesce("__own", "__before")).drop("__v", "__own", "__before")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__v", value).withColumn("__m", F.max("__v").over(inside))
    df = _carry(df, keys, [F.max("__v").alias("__top")], [("__before", F.max("__top"))])
    return df.withColumn(name, F.greatest("__m", "__before")).drop("__v", "__m", "__before")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__v", value).withColumn("__s", F.sum("__v").over(inside))
    df = _carry(df, keys, [F.sum("__v").alias("__all")], [("__before", F.sum("__all"))])
    return df.withColumn(name, (F.col("__s") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__v", "__s", "__before")


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their numbers from 1 in a total order: ranges of the order are sorted apart, and each begins after the rows before it.

    The sorted ranges are written before they are counted, as a range's borders come from a sample.
    """
    rows = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    per = rows.groupBy(part).agg(F.count("*").alias("__n"))  # a row for each range
    before = per.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    both = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    return both.withColumn(name, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1).drop("__id", "__part", "__before")
