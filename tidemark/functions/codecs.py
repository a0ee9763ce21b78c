"""Checksums, delta coding, and text forms of entries and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the bytes that a record's checksum starts with.
CRC_SEED = "C2A3066E"


def record_crc(payload: Column) -> Column:
    """CRC32 of a record's seed and bytes."""
    return F.crc32(F.concat(F.unhex(F.lit(CRC_SEED)), payload.cast("binary")))


def delta_encoded(values: Column) -> Column:
    """The first value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def delta_decoded(deltas: Column) -> Column:
    """Running sums of a delta-coded array."""
    start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(deltas, start, lambda a, d: F.struct(F.concat(a["out"], F.array(a["sum"] + d)).alias("out"), (a["sum"] + d).alias("sum")), lambda a: a["out"])


def entry_json(key: Column, value: Column) -> Column:
    return F.to_json(F.struct(key.alias("key"), value.alias("value")))


def operation_json() -> Column:
    """An operation with its position; deletes have no value."""
    return F.to_json(F.struct("position", F.lower("op").alias("type"), F.col("k").alias("key"), F.when(F.col("op") == "PUT", F.col("v")).alias("value")))


def digest(rows: DataFrame, key: str, value: str, width: int = 4096) -> DataFrame:
    """One digest of all pairs in key order: md5 of stretches of ``width`` pairs, then of stretches of those, so that no task
    holds all pairs.  A range of keys is digested by filtering ``rows``."""
    from ..operators.ordered import by_levels

    pairs = rows.select(key, F.concat_ws(":", F.col(key).cast("string"), F.col(value).cast("string")).alias("md5"))
    return by_levels(pairs, key, "md5", lambda parts: F.md5(F.array_join(parts, ",").cast("binary")), width)


def key_text(key: Column, prefix: str) -> Column:
    """A key as text under a prefix, as a shared cache holds it."""
    return F.concat(F.lit(prefix), key.cast("string"))


def text_key(text: Column, prefix: str, kind: str = "long") -> Column:
    """The key of such a text; null where the prefix or the key isn't one."""
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text)).try_cast(kind))


def epoch_text(millis: Column) -> Column:
    """Epoch milliseconds as text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
