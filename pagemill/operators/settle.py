"""Results that are used several times, written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder: worked out once, and safe from lost executors.

    The folder is the session's (``spark.checkpoint.dir``); one is made only where none is set on a local master, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagemill-"))
    return df.checkpoint(eager=True)
