"""Nearest keys: floor, lower, ceiling and higher of each probe among the live keys, as one as-of join.

Keys and probes meet in ranges of the key, which are dealt and written once; a range needs from the others only the
largest (smallest) key before (after) it.  Tombstones must be gone before: a neighbour is a live key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import RANGE, ranged

#: The direction of the search, and whether an equal key counts.
KINDS = {"floor": (False, True), "lower": (False, False), "ceil": (True, True), "higher": (True, False)}


def neighbors(live: DataFrame, probes: DataFrame, kind: str, key: str = "k", probe: str = "p", found: str = "found") -> DataFrame:
    """Every row of ``probes`` with ``found``: its neighbour's key, or null.  A null probe finds nothing."""
    forward, equal = KINDS[kind]
    # equal keys and probes: the key comes first in the order of the scan if it counts
    side = F.lit(0 if equal else 1)
    keys = live.select(F.col(key).alias("_at"), F.col(key).alias("_key"), side.alias("_side")).where("_at is not null").distinct()
    asked = probes.select(F.col(probe).alias("_at")).where("_at is not null").distinct().select("_at", F.lit(None).cast(live.schema[key].dataType).alias("_key"), (1 - side).alias("_side"))
    both = ranged(keys.union(asked), "_at")
    order = [F.desc("_at") if forward else F.asc("_at"), F.asc("_side")]
    scan = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_near", F.last("_key", ignorenulls=True).over(scan)).where(F.col("_key").isNull())
    whole = both.groupBy(RANGE).agg((F.min if forward else F.max)("_key").alias("_end"))
    over = Window.orderBy(F.desc(RANGE) if forward else F.asc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(RANGE, F.last("_end", ignorenulls=True).over(over).alias("_carry"))
    answers = inside.join(F.broadcast(carry), RANGE).select(F.col("_at").alias(probe), F.coalesce("_near", "_carry").alias(found))
    return probes.join(answers, probe, "left")
