"""A cache tier before a store: read-through, priming, expiry and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def read_through(requested: DataFrame, cache: DataFrame, store: DataFrame) -> DataFrame:
    """Each requested key once: its value from the cache, else from the store, and the source ('miss': neither)."""
    cached = cache.select("k", F.col("v").alias("cache_v"), F.lit(True).alias("in_cache"))
    stored = store.select("k", F.col("v").alias("store_v"), F.lit(True).alias("in_store"))
    found = requested.select("k").distinct().join(cached, "k", "left").join(stored, "k", "left")
    source = F.when(F.col("in_cache"), "cache").when(F.col("in_store"), "store").otherwise("miss")
    return found.select("k", F.when(F.col("in_cache"), F.col("cache_v")).otherwise(F.col("store_v")).alias("v"), source.alias("source"))


def written_back(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache with what the store answered; entries that are there stay as they are."""
    return cache.select("k", "v").union(answers.where("source = 'store'").select("k", "v"))


def prime_plan(keys: DataFrame, cache: DataFrame, store: DataFrame) -> DataFrame:
    """What priming writes: keys that the cache lacks and the store has."""
    return keys.select("k").distinct().join(cache.select("k"), "k", "left_anti").join(store.select("k", "v"), "k")


def primed(keys: DataFrame, cache, store: DataFrame) -> DataFrame:
    """Prime a cache (a Store): write what it lacks and the store has, and give the counts requested, skipped (in the cache
    before), primed and missing (nowhere)."""
    from ..sources.tables import stored

    answers = stored(read_through(keys, cache.view(), store), "prime")
    cache.commit(answers.where("source = 'store'").select(F.lit(0).cast("long").alias("position"), "k", F.lit("PUT").alias("op"), "v"))
    source = F.col("source")
    return answers.agg(F.count("*").alias("requested"), F.count_if(source == "cache").alias("skipped"), F.count_if(source == "store").alias("primed"), F.count_if(source == "miss").alias("missing"))


def stats(answers: DataFrame) -> DataFrame:
    """Counts of requests and of each source."""
    source = F.col("source")
    return answers.agg(F.count("*").alias("requested"), F.count_if(source == "cache").alias("cache_hits"), F.count_if(source == "store").alias("store_hits"), F.count_if(source == "miss").alias("misses"))


def alive(rows: DataFrame, ts: str, hours: int, now: Column, for_good: Column | None = None) -> DataFrame:
    """Entries whose time to live isn't over.  Those that were set (``for_good``), and not merely added, have no end."""
    fresh = F.col(ts) + F.expr(f"interval {hours} hours") > now
    return rows.where(fresh if for_good is None else for_good | fresh)
