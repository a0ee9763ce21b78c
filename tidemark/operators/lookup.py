"""Point and batch lookups on a merged state, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .merge import DELETE, newest


def get(state: DataFrame, key) -> DataFrame:
    """The live row of a key; the filter is on the key, so it goes below the merge and into the scan."""
    return state.where((F.col("k") == F.lit(key)) & (F.col("op") != DELETE))


def tristate(state: DataFrame, probes: DataFrame, probe: str = "p") -> DataFrame:
    """Each probe with is_deleted: null (never seen), true or false."""
    known = state.select(F.col("k").alias(probe), (F.col("op") == DELETE).alias("is_deleted"))
    return probes.join(known, probe, "left")


def multi_get(live: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested keys that exist, with their values; a key asked for twice is answered once."""
    return requested.select("k").distinct().join(live.select("k", "v"), "k")


def hits(live: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("k").distinct().join(live.select("k"), "k", "left_semi")


def misses(live: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("k").distinct().join(live.select("k"), "k", "left_anti")


def get_all(live: DataFrame, requested: DataFrame) -> DataFrame:
    """Every requested key once, with its value or null."""
    return requested.select("k").distinct().join(live.select("k", "v"), "k", "left")


def indirect(index: DataFrame, log: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Values by key, through addresses: index (k, address) to log (address, k, v).  A record of another key is no hit."""
    index = index if requested is None else requested.select("k").distinct().join(index, "k")
    found = index.select("k", "address").join(log.select("address", F.col("k").alias("log_k"), "v"), "address")
    return found.where(F.col("k") == F.col("log_k")).select("k", "address", "v")


def reindexed(index: DataFrame, log: DataFrame) -> DataFrame:
    """Repairs of an index: keys whose address is in the log's segment but isn't that of their last put there.

    ``log`` has segment, address, k and op; the result has k, the old and the right address.
    """
    last = newest(log.where(F.col("op") == "PUT"), ["segment", "k"], F.desc("address")).select("segment", "k", F.col("address").alias("right"))
    return index.join(last, ["segment", "k"]).where(F.col("address") != F.col("right")).select("k", "segment", "address", "right")


def first_last(live: DataFrame) -> DataFrame:
    """First and last live entry."""
    return live.agg(F.min("k").alias("first_k"), F.min_by("v", "k").alias("first_v"), F.max("k").alias("last_k"), F.max_by("v", "k").alias("last_v"))


def streamed(index: DataFrame, log: DataFrame, requested: DataFrame) -> DataFrame:
    """Batch lookup with an error column instead of exceptions: k, v and error (null, 'missing', 'wrong key').

    Addresses are dealt to ranges and sorted before the log is asked, so that a task reads neighbouring records.
    """
    asked = requested.select("k").distinct().join(index.select("k", "address"), "k", "left").repartitionByRange("address").sortWithinPartitions("address")
    found = asked.join(log.select("address", F.col("k").alias("log_k"), "v"), "address", "left")
    wrong = F.col("log_k").isNotNull() & (F.col("log_k") != F.col("k"))
    error = F.when(F.col("log_k").isNull(), "missing").when(wrong, "wrong key")
    return found.select("k", F.when(error.isNull(), F.col("v")).alias("v"), error.alias("error"))


def skipping(answers: DataFrame) -> DataFrame:
    """Of :func:`streamed`: how many keys were asked for, found and skipped, by reason."""
    error = F.col("error")
    return answers.agg(F.count("*").alias("asked"), F.count_if(error.isNull()).alias("found"), F.count_if(error == "missing").alias("missing"), F.count_if(error == "wrong key").alias("wrong_key"))


def top_of_each(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
