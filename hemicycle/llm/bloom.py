"""Blocked Bloom filters as DataFrames (built-in functions only).

A filter is a table (block, bits): one 4 KB bitmap per block that holds a set position. A hash chooses its block and two
positions in it. Building is a hash aggregate; testing is a broadcast lookup of at most ``MAX_BITS / 8`` bytes, whatever
the number of keys. Beyond that size the filter lets more rows through, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
BITS_PER_KEY = 16
MAX_BITS = 1 << 28


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> int:
    return (min(max(keys * bits_per_key, BLOCK_BITS), max(max_bits, BLOCK_BITS)) + BLOCK_BITS - 1) // BLOCK_BITS


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    pos = [F.pmod(F.shiftrightunsigned(h, s), F.lit(BLOCK_BITS)).cast("int") for s in (3, 31)]
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int"), pos


def build(df: DataFrame, key: Column, blocks: int, least: int = 1) -> DataFrame:
    """(block, bits) of the positions set by at least ``least`` rows."""
    block, pos = _place(key, blocks)
    hits = df.select(block.alias("block"), F.explode(F.array_distinct(F.array(*pos))).alias("bit")).groupBy("block", "bit")
    hits = hits.agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= least)
    return hits.groupBy("block").agg(F.expr("bitmap_construct_agg(cast(bit as bigint))").alias("bits"))


def _is_set(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, pos % 8) == 1


def test(df: DataFrame, key: Column, filt: DataFrame, blocks: int, out: str = "maybe") -> DataFrame:
    """``df`` with a boolean: false only for keys that are not in the filter."""
    block, pos = _place(key, blocks)
    look = filt.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    return (df.withColumn("_block", block).join(F.broadcast(look), "_block", "left")
            .withColumn(out, F.coalesce(_is_set(F.col("_bits"), pos[0]) & _is_set(F.col("_bits"), pos[1]), F.lit(False)))
            .drop("_block", "_bits"))
