"""Bloom filters as tables: built, stored and asked by built-in expressions.

A filter has blocks of 32,768 bits (4 kB).  A key belongs to one block and sets ``PROBES`` bits of
it.  Blocks are rows, keyed by ``spot`` (the filter's seed and the block's number), so filters of
many folders are one table in buckets, and asking moves the asked keys only, however large the
filters are.  There are no false negatives; positives have to be looked up.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "spot BIGINT, bits BINARY"
BLOCK_BITS = 8 * 4096
BITS_PER_KEY = 12
PROBES = 6


def new_seed() -> int:
    return random.SystemRandom().randrange(1 << 30)


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS))


def _spot(key: str, seed: Column, blocks: Column) -> Column:
    return seed.cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.lit(0), key), blocks.cast("long"))


def _bits(key: str) -> Column:
    """Places of the bits of a key in its block."""
    h = F.xxhash64(F.lit(1), key)
    step = F.shiftrightunsigned(h, 40) * 2 + 1
    return F.array(*[F.pmod(F.shiftright(h, 20) + step * k, F.lit(BLOCK_BITS)).cast("long") for k in range(PROBES)])


def build(keys: DataFrame, key: str, seed: int, blocks: int) -> DataFrame:
    """``spot, bits``: the blocks of a filter with all keys."""
    placed = keys.select(_spot(key, F.lit(seed), F.lit(blocks)).alias("spot"), F.explode(_bits(key)).alias("bit"))
    return placed.groupBy("spot").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def ask(asked: DataFrame, key: str, filters: DataFrame, which: list[tuple[int, int]]) -> DataFrame:
    """``key, seed`` for every filter of ``which`` (seed, blocks) that may hold the key."""
    each = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("seed"), F.lit(b).cast("long").alias("blocks")) for s, b in which]))
    put = asked.select(key, each.alias("f")).select(
        key, F.col("f.seed").alias("seed"), _spot(key, F.col("f.seed"), F.col("f.blocks")).alias("spot"), _bits(key).alias("_at"))
    byte = lambda at: F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda at: F.getbit(byte(at), (at % 8).cast("int")) == 1
    held = filters.join(put.hint("shuffle_hash"), "spot")
    return held.filter(F.forall("_at", is_set)).select(key, "seed")
