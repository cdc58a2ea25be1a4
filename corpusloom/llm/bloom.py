"""A blocked Bloom filter as a table: eight 64-bit words a block, one bit of a key in each word of its block.

Its size is bounded by a parameter whatever the number of keys, so it may be broadcast. A long list makes it let
more rows through; it never holds back a row whose key is listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 32 << 20


def _bits(key: Column) -> list[Column]:
    """For each word of the block, a word with the key's bit set."""
    h = F.xxhash64(key, F.lit("bit"))
    at = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in at]


def blocked_bloom(keys: DataFrame, n_keys: int, max_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, int]:
    """(_block, _w0.._w7) of the first column of keys, and the number of blocks; empty blocks have no row."""
    key = F.col(keys.columns[0])
    blocks = max(1, min(max_bytes // (WORDS * 8), math.ceil(n_keys * BITS_PER_KEY / (WORDS * 64))))
    words = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), *[b.alias(f"_w{i}") for i, b in enumerate(_bits(key))])
    return words.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)]), blocks


def with_maybe(rows: DataFrame, key: Column, bloom: tuple[DataFrame, int], name: str = "maybe") -> DataFrame:
    """rows with whether the filter lets their key through."""
    table, blocks = bloom
    probe = rows.withColumn("_at", F.pmod(F.xxhash64(key), F.lit(blocks)))
    probe = probe.join(F.broadcast(table), F.col("_at") == F.col("_block"), "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(key)):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    return probe.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_at", "_block", *[f"_w{i}" for i in range(WORDS)])
