"""Computations over one total order, without one task that holds it all.

Rows are dealt to ranges of the order key, as many as the session has shuffle partitions, and written with their range's
number.  Windows run inside a range; what they need from earlier ranges is one row for each range, summed up in order.
Ties of the order key stay in one range, so the key should be unique or nearly so.  Rows that have their range keep it, so
that several computations share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import stored

RANGE = "_range"


def ranged(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the number of their range (nulls stand in the first)."""
    if RANGE in rows.columns:
        return rows
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, key).withColumn(RANGE, F.spark_partition_id()), "ranged")


def _before(per_range: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Running values over the ranges before each one: a window over as many rows as there are ranges."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(RANGE, *(c.over(earlier).alias(n) for n, c in columns.items()))


def _shed(rows: DataFrame, placed: DataFrame, *names: str) -> DataFrame:
    """Without helpers, and without the range unless the input had it."""
    return placed.drop(*names, *(() if RANGE in rows.columns else (RANGE,)))


def numbered(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows with their number (from 1) in the order of ``key``."""
    placed = ranged(rows, key)
    sizes = placed.groupBy(RANGE).agg(F.count("*").alias("_size"))
    before = _before(sizes, {"_before": F.sum("_size")})
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(key))
    placed = placed.withColumn("_inside", inside).join(F.broadcast(before), RANGE).withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
    return _shed(rows, placed, "_inside", "_before")


def lagged(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Rows with ``column`` of the row before in the order of ``key`` (null for the first)."""
    placed = ranged(rows, key)
    ends = placed.groupBy(RANGE).agg(F.max_by(F.struct(column), key).alias("_end"))
    before = _before(ends, {"_before": F.last("_end", ignorenulls=True)})
    inside = Window.partitionBy(RANGE).orderBy(key)
    first = F.row_number().over(inside) == 1
    placed = placed.withColumn("_first", first).withColumn("_lag", F.lag(column).over(inside)).join(F.broadcast(before), RANGE)
    return _shed(rows, placed.withColumn(name, F.when(F.col("_first"), F.col("_before")[column]).otherwise(F.col("_lag"))), "_first", "_lag", "_before")


def carried(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Rows with the last ``column`` that isn't null, up to and with each, in the order of ``key``."""
    placed = ranged(rows, key)
    ends = placed.groupBy(RANGE).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(key))).alias("_end"))
    before = _before(ends, {"_before": F.last("_end", ignorenulls=True)})
    inside = Window.partitionBy(RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_inside", F.last(column, ignorenulls=True).over(inside)).join(F.broadcast(before), RANGE)
    return _shed(rows, placed.withColumn(name, F.coalesce("_inside", "_before")), "_inside", "_before")


def running_sum(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over all rows up to each, in the order of ``key``."""
    placed = ranged(rows, key).withColumn("_value", value)
    sums = placed.groupBy(RANGE).agg(F.sum("_value").alias("_sum"))
    before = _before(sums, {"_before": F.sum("_sum")})
    inside = Window.partitionBy(RANGE).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_inside", F.sum("_value").over(inside)).join(F.broadcast(before), RANGE).withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
    return _shed(rows, placed, "_value", "_inside", "_before")


def by_levels(rows: DataFrame, key: str, value: str, combine, width: int = 4096, least: int = 2) -> DataFrame:
    """One row ``value``: stretches of ``width`` values in key order are combined, then stretches of the results, until one
    is left (after ``least`` levels at the earliest).  No list has more than ``width`` values.

    ``combine`` makes a value of the same type from an array of them.
    """
    level = stored(numbered(rows.select(key, value), key, "_n").select((F.col("_n") - 1).alias("n"), value), "level")
    count, levels = level.count(), 0
    while count > 1 or levels < least:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", value))), lambda x: x[value])
        level = stored(level.groupBy(F.floor(F.col("n") / width).alias("n")).agg(combine(ordered).alias(value)), "level")
        count, levels = -(-count // width), levels + 1
    return level.select(value)
