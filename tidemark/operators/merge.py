"""Merging runs of operations: the newest wins, deletes are rows until the oldest run takes part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DELETE = "DELETE"


def newest(rows: DataFrame, keys: list[str], *recency: Column) -> DataFrame:
    """The newest row of each key.  ``recency`` sorts the newest first and should be unique in a key.

    The rank is limited before the shuffle too, so a key that holds many rows sends few from each task.
    """
    order = Window.partitionBy(*keys).orderBy(*recency)
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def runs(ops: DataFrame) -> DataFrame:
    """Each generation's newest operation of each key."""
    return newest(ops, ["gen", "k"], F.desc("position"))


def merged(generations: DataFrame) -> DataFrame:
    """State across generations: of each key the row of the newest generation (0 first), deletes included."""
    return newest(generations, ["k"], F.asc("gen"), F.desc("position"))


def live(state: DataFrame) -> DataFrame:
    """Rows that are not deletes.  Only a merged state may lose its deletes: before, old puts would come back."""
    return state.where(F.col("op") != DELETE)


def latest(ops: DataFrame) -> DataFrame:
    """The live state of a log."""
    return live(newest(ops, ["k"], F.desc("position")))


def compacted(generations: DataFrame, gens: list[int], reaches_oldest: bool) -> DataFrame:
    """One run from neighbouring generations; deletes go only if nothing older is left that they could hide."""
    state = merged(generations.where(F.col("gen").isin(gens)))
    return live(state) if reaches_oldest else state


def tiered(sizes: list[tuple[bool, int]]) -> int:
    """How many runs, newest first, a size-tiered compaction takes: all volatile ones, then a stable one as long as
    twice the sum so far exceeds its size.  ``sizes``: (volatile, size) of the runs, newest first."""
    total = taken = 0
    for volatile, size in sizes:
        if not volatile and not 2 * total > size:
            break
        total += size
        taken += 1
    return taken


def generation_stats(generations: DataFrame) -> DataFrame:
    """Entries, tombstones, key range and whether there are deletes, for each generation."""
    dead = F.col("op") == DELETE
    return generations.groupBy("gen").agg(F.count("*").alias("entries"), F.count_if(dead).alias("tombstones"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.bool_or(dead).alias("has_deletions"))
