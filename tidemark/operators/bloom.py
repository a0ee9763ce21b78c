"""Bloom membership as tables: a filter is its non-empty words of 64 bits, spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the filter: bits for each key, and hashes of each key.
BITS_PER_KEY = 8
HASHES = 6


def _bits(key: Column, size: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), size) for i in range(HASHES)))


def built(keys: DataFrame, key: str = "k") -> DataFrame:
    """word, mask and size (bits) of a filter of the distinct keys."""
    size = keys.select(key).distinct().agg(F.greatest(F.count("*") * BITS_PER_KEY, F.lit(64)).alias("size"))
    bits = keys.select(key).crossJoin(F.broadcast(size)).select("size", F.explode(_bits(F.col(key), F.col("size"))).alias("bit"))
    return bits.groupBy(F.shiftright("bit", 6).alias("word"), "size").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))


def maybe(probes: DataFrame, bloom: DataFrame, key: str = "k") -> DataFrame:
    """The distinct probes with ``maybe``: false only for keys that the filter never saw."""
    size = bloom.agg(F.coalesce(F.max("size"), F.lit(64)).alias("size"))
    asked = probes.select(key).distinct().crossJoin(F.broadcast(size)).select(key, F.explode(F.array_distinct(_bits(F.col(key), F.col("size")))).alias("bit"))
    found = asked.withColumn("word", F.shiftright("bit", 6)).join(bloom.select("word", "mask"), "word", "left")
    is_set = F.expr("(coalesce(mask, 0L) & shiftleft(1L, cast(bit & 63 as int))) <> 0")
    return found.groupBy(key).agg(F.bool_and(is_set).alias("maybe"))
