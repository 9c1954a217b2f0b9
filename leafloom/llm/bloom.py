"""A blocked Bloom filter as a small table: 64-bit blocks, four bits an entry, bounded in size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import unused

#: Blocks of a filter at most: 16 MB on an executor. A fuller filter lets more pass, which the join after it removes.
MOST_BLOCKS = 1 << 20


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).cast("int")


def mask_of(h: Column) -> Column:
    """Four bits of the 64 of a block."""
    bits = []
    for k in range(4):
        shift = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits.append(F.call_function("shiftleft", F.lit(1).cast("long"), shift))
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def blocks_for(entries: int, most: int = MOST_BLOCKS) -> int:
    """About 12 bits an entry."""
    return min(most, max(1, 1 << math.ceil(math.log2(max(entries, 1) * 12 / 64 + 1))))


def table_of(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """(block, bits), `blocks` rows at most."""
    return keys.select(block_of(h, blocks).alias("block"), mask_of(h).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def passed(rows: DataFrame, keys: DataFrame, h: str, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows whose 64-bit hash may be one of `keys` (a column of the same name). Columns stay."""
    blocks = blocks_for(keys.count(), most_blocks)
    block, bits = unused(rows, "block"), unused(rows, "bits")
    filled = table_of(keys, F.col(h), blocks).select(F.col("block").alias(block), F.col("bits").alias(bits))
    tested = rows.withColumn(block, block_of(F.col(h), blocks)).join(F.broadcast(filled), block)
    return tested.where(F.col(bits).bitwiseAND(mask_of(F.col(h))) == mask_of(F.col(h))).drop(block, bits)
