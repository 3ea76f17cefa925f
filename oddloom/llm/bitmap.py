"""Narrowing a large side to a set of keys without shuffling what cannot match.

A bitmap of fixed size is made of the keys and sent ahead of the exact join: its size does not grow with the data, and
what it lets through wrongly the join removes. When the keys outgrow it, it only saves less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITS = 1 << 26


def flagged(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` with __likely: false only where ``column`` is certainly not among ``keys`` (one column of that name)."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS))
    maps = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    placed = rows.withColumn("__map", F.bitmap_bucket_number(bit)).withColumn("__at", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.expr("substring(__bits, int(__at div 8) + 1, 1)")), 16, 10).cast("int")
    held = F.expr("int(power(2, __at % 8))")
    joined = placed.join(F.broadcast(maps), "__map", "left")  # at most BITS / 8 bytes
    return joined.withColumn("__likely", F.coalesce(byte.bitwiseAND(held) != 0, F.lit(False))).drop("__map", "__at", "__bits")


def narrowed(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``keys``."""
    return flagged(rows, column, keys).filter("__likely").drop("__likely").join(keys, column, "left_semi")
