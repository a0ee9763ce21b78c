"""Operation logs as DataFrames: puts, deletes, batch deletes and checkpoints in order of ``position``.

Columns: position, k, op (PUT, DELETE, CHECKPOINT), v, and gen (0 is the newest generation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import table

PUT, DELETE, CHECKPOINT = "PUT", "DELETE", "CHECKPOINT"


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log of the events table: an error deletes its key, any other event puts its value."""
    gen = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), 3).when(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"), 2)
    gen = gen.when(F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"), 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("position"), (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("k"), F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("v"), gen.alias("gen"), "ts", "user_id", "event_type",
    )


def exploded(ops: DataFrame) -> DataFrame:
    """One row for each key of batch deletes (column ``keys``); other rows keep their key."""
    return ops.withColumn("k", F.explode_outer(F.when(F.col("keys").isNotNull(), F.col("keys")).otherwise(F.array("k")))).drop("keys")


def batch_deletes(ops: DataFrame, every: int = 100) -> DataFrame:
    """Deletes of each stretch of positions as one operation with its sorted keys."""
    return ops.where(F.col("op") == DELETE).groupBy(F.floor(F.col("position") / every).alias("batch")).agg(F.min("position").alias("position"), F.array_sort(F.collect_set("k")).alias("keys"))


def before_first(ops: DataFrame, bad: Column) -> DataFrame:
    """Rows before the first position where ``bad`` holds: a log ends at its first unreadable record."""
    cut = ops.where(bad).agg(F.min("position").alias("cut"))
    return ops.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col("position") < F.col("cut"))).drop("cut")


def before_gap(rows: DataFrame) -> DataFrame:
    """Rows of segments (column ``segment``) before the first that is missing, counted from the first present one."""
    numbers = rows.select("segment").distinct()
    hole = numbers.select((F.col("segment") + 1).alias("segment")).join(numbers, "segment", "left_anti").agg(F.min("segment").alias("hole"))
    return rows.crossJoin(F.broadcast(hole)).where(F.col("segment") < F.col("hole")).drop("hole")


def checkpointed(ops: DataFrame, positions: list[int]) -> DataFrame:
    """Operations before each checkpoint: a row for each checkpoint that an operation belongs to."""
    marks = F.filter(F.array(*(F.lit(p).cast("long") for p in positions)), lambda p: F.col("position") < p)
    return ops.withColumn("checkpoint", F.explode(marks))
