"""Connected components over an edge table, by minimum labels with shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .session import dropped, stored


def collapsed(edges: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` (b < a) with the same components: each node's smaller neighbours hang on the smallest of them.

    Edges that tell the same of a node, from many sources, become one.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = pairs.groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("all"))
    rest = F.transform(F.filter("all", lambda x: x != F.col("b")), lambda x: F.struct(x.alias("a"), F.col("b")))
    return near.select(F.inline(F.concat(F.array(F.struct("a", "b")), rest))).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``id`` and ``component`` (the smallest id) of every node of the edges ``a``, ``b`` (any direction, repeats)."""
    spark = edges.sparkSession
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(collapsed(edges).select(F.inline(ways)), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("over"))
        step = stored(step.join(jump, "component", "left").select("id", "old", F.least("component", "over").alias("component")), f"{name}-labels")
        dropped(spark, labels)
        labels = step.select("id", "component")
        if not step.where("old <> component").limit(1).count():
            dropped(spark, both)
            return labels
