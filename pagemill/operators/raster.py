"""Rasters: histograms of samples, the background value, and the share of samples that differ from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTOGRAM = pa.list_(pa.struct([("v", pa.int32()), ("n", pa.int64()), ("first", pa.int64())]))


def histogram(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, how often each occurs, and where first."""
    v, first, n = np.unique(values, return_index=True, return_counts=True)
    return v, n, first


def histograms(rasters: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """``keys, h``: each row's histogram, an array of ``v, n, first``. Samples are counted where they lie; none is a row of its own.

    Null samples don't count; a null or empty raster has an empty histogram.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rasters.schema}

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(len(keys))
                sizes = [0 if x is None else x for x in pc.list_value_length(lists).to_pylist()]
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                flat = lists.flatten()
                hollow = np.asarray(flat.is_null()) if flat.null_count else None
                values = flat.fill_null(0).to_numpy(zero_copy_only=False)
                found = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = values[a:b] if hollow is None else values[a:b][~hollow[a:b]]
                    found.append(histogram(own))
                offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found], dtype=np.int64)]).astype(np.int32)
                columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3)]
                entries = pa.StructArray.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.int64))], ["v", "n", "first"])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.ListArray.from_arrays(pa.array(offsets), entries)], [*keys, "h"])

    rows = rasters.select(*keys, F.col(samples).cast("array<int>").alias(samples))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", h array<struct<v:int,n:bigint,first:bigint>>")


def merged(parts: DataFrame, key: str, tile: str) -> DataFrame:
    """Histograms of rasters that lie in several rows, in the order of their tiles. What is shuffled is a row for each different value of a tile, at most 65,536."""
    rows = parts.select(key, tile, F.explode("h").alias("e"))
    one = rows.groupBy(key, F.col("e.v").alias("v")).agg(F.sum("e.n").alias("n"), F.min(F.struct(F.col(tile).alias("tile"), F.col("e.first").alias("first"))).alias("at"))
    return one.groupBy(key).agg(F.collect_list(F.struct("v", "n", F.col("at").alias("first"))).alias("h"))


def background(h: Column, by_tile: bool = False) -> Column:
    """The most frequent value, of equals the first seen."""
    earlier = (lambda x: F.struct(-x["first"]["tile"], -x["first"]["first"])) if by_tile else (lambda x: -x["first"])
    return F.array_max(F.transform(h, lambda x: F.struct(x["n"].alias("n"), earlier(x).alias("e"), x["v"].alias("v"))))["v"]


def pixel_coverage(rasters: DataFrame, key: str, samples: str = "samples", maximum: int = 255, tile: str | None = None) -> DataFrame:
    """The most frequent sample (the first seen of equals) and the share of samples farther from it than a 64th of the maximum.

    A raster is one row, and gives one row without a shuffle; with ``tile`` (a number) its samples are those of all rows
    of its key. Empty rasters give no row.
    """
    h = histograms(rasters, [key], samples) if tile is None else merged(histograms(rasters, [key, tile], samples), key, tile)
    rows = h.where(F.size("h") > 0).select(key, "h", background(F.col("h"), tile is not None).alias("background"))
    limit = max(1, maximum // 64)
    total = lambda test: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x), x["n"]).otherwise(0))
    visible = total(lambda x: F.abs(x["v"] - F.col("background")) > limit)
    return rows.select(key, "background", (visible / total(lambda x: F.lit(True))).alias("coverage"))


def visible_documents(coverage: DataFrame, key: str, least: float = 0.0001) -> DataFrame:
    """Whether any page of a document shows something."""
    return coverage.groupBy(key).agg(F.bool_or(F.col("coverage") >= least).alias("visible"))
