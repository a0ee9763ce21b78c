"""Operations on sequences in one total order: prefixes, runs of neighbours, chunks, separators, merges and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from .ordered import RANGE, by_levels, carried, lagged, numbered, ranged, running_sum


def span(rows: DataFrame, key: str, holds: Column) -> tuple[DataFrame, DataFrame]:
    """The longest prefix in key order on which ``holds``, and the rest."""
    cut = F.broadcast(rows.where(~F.coalesce(holds, F.lit(False))).agg(F.min(key).alias("_cut")))
    marked = rows.crossJoin(cut)
    first = F.col("_cut").isNull() | (F.col(key) < F.col("_cut"))
    return marked.where(first).drop("_cut"), marked.where(~first).drop("_cut")


def adjacent_groups(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Runs of neighbours in key order that have one value: run, the value, its first and last key and its length."""
    turned = lagged(ranged(rows.select(key, column), key), key, column, "_last")
    flagged = turned.withColumn("_turn", F.when(F.col("_last").eqNullSafe(F.col(column)), 0).otherwise(1))
    runs = running_sum(flagged, key, F.col("_turn"), "run")
    return runs.groupBy("run").agg(F.first(column).alias(column), F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def chunks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with ``chunk``: consecutive stretches of ``size`` rows in key order, from 0."""
    return numbered(rows, key, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n")


def interspersed(rows: DataFrame, key: str, value: str, separator) -> DataFrame:
    """Places and values with a separator between neighbours: place runs from 1 without gaps."""
    placed = numbered(rows.select(key, value), key, "_n")
    kind = rows.schema[value].dataType
    own = placed.select((2 * F.col("_n") - 1).alias("place"), F.col(value))
    between = placed.where("_n > 1").select((2 * F.col("_n") - 2).alias("place"), F.lit(separator).cast(kind).alias(value))
    return own.union(between)


def intercalated(groups: DataFrame, key: str, values: str, separator: list) -> DataFrame:
    """The elements of arrays in key order with the separator's elements between the arrays: place, value."""
    kind = groups.schema[values].dataType
    n = numbered(groups.select(key, values), key, "_n")
    glued = n.withColumn("_all", F.when(F.col("_n") > 1, F.concat(F.array(*(F.lit(s) for s in separator)).cast(kind), values)).otherwise(F.col(values)))
    placed = running_sum(glued.withColumn("_size", F.size("_all")), key, F.col("_size"), "_end")
    return placed.select(F.posexplode("_all").alias("_at", "value"), (F.col("_end") - F.col("_size")).alias("_base")).select((F.col("_base") + F.col("_at") + 1).alias("place"), "value")


def intercalated_rows(rows: DataFrame, group: str, value: str, separator: list) -> DataFrame:
    """Values in the order of group and value, with the separator's elements between groups: place, value.

    Groups are never collected, so they may have any size; a group without rows doesn't exist here.
    """
    kind = rows.schema[value].dataType
    marked = _turns(rows, group, value).withColumn("_size", F.when(F.col("_new") & F.col("_last").isNotNull(), len(separator)).otherwise(0) + 1)
    placed = running_sum(marked, "_key", F.col("_size"), "place")
    between = F.posexplode(F.array(*(F.lit(s) for s in separator)).cast(ArrayType(kind))).alias("_at", "value")
    apart = placed.where("_size > 1").select("place", between).select((F.col("place") - len(separator) + F.col("_at")).alias("place"), "value")
    return placed.select("place", F.col(value).alias("value")).union(apart)


def _turns(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows in ranges of ``_key``, group and value, with the row before (``_last``), and whether a group begins (``_new``)."""
    keyed = ranged(rows.select(group, value).withColumn("_key", F.struct(group, value)), "_key")
    return lagged(keyed, "_key", "_key", "_last").withColumn("_new", F.col("_last").isNull() | ~F.col("_last")[group].eqNullSafe(F.col(group)))


def deltas(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows with ``delta``: the value less the one before it in its group, or the value itself for the first."""
    return _turns(rows, group, value).withColumn("delta", F.col(value) - F.when(F.col("_new"), 0).otherwise(F.col("_last")[value])).select(group, value, "delta")


def undeltas(rows: DataFrame, key: str, group: str, delta: str, name: str) -> DataFrame:
    """Running sums of ``delta`` inside each group (column ``name``); ``key`` orders all rows, group by group."""
    turned = lagged(ranged(rows.withColumn("_group", F.struct(group)), key), key, "_group", "_last")
    summed = running_sum(turned, key, F.col(delta), "_total")
    new = F.col("_last").isNull() | (F.col("_last")[group].eqNullSafe(F.col(group)) == F.lit(False))
    based = carried(summed.withColumn("_start", F.when(new, F.col("_total") - F.col(delta))), key, "_start", "_base")
    return based.withColumn(name, F.col("_total") - F.col("_base")).drop("_group", "_last", "_total", "_start", "_base", RANGE)


def merge(*parts: DataFrame, key: str = "k") -> DataFrame:
    """All rows of all parts in key order, repeats kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(key)


def process(rows: DataFrame, key: str, value: Column, limit: Column) -> DataFrame:
    """Process rows in key order until the sum of ``value`` reaches ``limit``: the rows that were processed, with the sum so
    far (``total``).  The row that reaches it is the last; all rows, if none does."""
    summed = running_sum(ranged(rows, key), key, value, "total").drop(RANGE)
    last = F.broadcast(summed.where(F.col("total") >= limit).agg(F.min(key).alias("_last")))
    return summed.crossJoin(last).where(F.col("_last").isNull() | (F.col(key) <= F.col("_last"))).drop("_last")


def affine_fold(rows: DataFrame, key: str, value: str, factor: int, modulus: int) -> DataFrame:
    """The fold acc -> (acc * factor + value) mod modulus in key order, from 0, as one row.

    Steps of this form combine associatively, so stretches of the order are folded apart, and their results in order.
    """
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def fold(steps: Column) -> Column:
        return F.aggregate(steps, start, lambda s, p: F.struct((s["a"] * p["a"] % modulus).alias("a"), ((s["b"] * p["a"] + p["b"]) % modulus).alias("b")))

    steps = rows.select(key, F.struct(F.lit(factor).cast("long").alias("a"), (F.col(value).cast("long") % modulus).alias("b")).alias("step"))
    return by_levels(steps, key, "step", fold).select(F.col("step.b").alias("fold"))
