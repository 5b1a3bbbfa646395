"""A bit map of fixed size that keeps most rows without a partner out of a join's shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut

#: Words of 64 bits: the map is 1 MB whatever the input is.
WORDS = 1 << 17


def maybe_in(rows: DataFrame, wanted: DataFrame, hash_col: str) -> DataFrame:
    """``rows`` without most of those whose ``hash_col`` (64 bits) is not in ``wanted``; an exact join must follow.

    A full map lets all through; the result of the join is the same.
    """
    place = F.pmod(F.col(hash_col), F.lit(WORDS * 64))
    word, bit = F.shiftright(place, 6).cast("int"), (place % 64).cast("int")
    set_bits = wanted.select(word.alias("word"), F.expr(f"shiftleft(1L, cast(pmod({hash_col}, 64) as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b"))
    dense = wanted.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("word")).join(set_bits, "word", "left")
    every = dense.select(F.struct("word", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("s"))
    # WORDS rows, gathered to the one row that is sent
    bits = every.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]).alias("bits"))
    return rows.join(F.broadcast(cut(bits)), F.getbit(F.element_at("bits", word + 1), bit) == 1, "left_semi")
