"""A map of bits that tells rows that cannot be among some keys, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_BITS = 23


def _place(keys: list[str]) -> tuple[Column, Column]:
    names = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"cast(shiftrightunsigned(pmod(xxhash64({names}), {1 << MAP_BITS}), 6) as int)"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({names}), {1 << MAP_BITS}) % 64 as int))")


def marked(df: DataFrame, wanted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a boolean column that is false only for rows whose keys are certainly not in ``wanted``.

    The keys set bits of a map of 2**MAP_BITS bits, at most 2**(MAP_BITS - 6) rows of one long, which is broadcast. With more keys the map fills up and sifts less; no key is lost.
    """
    word, mask = _place(keys)
    bits = wanted.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))
    return df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").withColumn(name, hit).drop("_word", "_bits")
