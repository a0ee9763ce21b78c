"""Session helpers: the tables, the shared folder and the size of Arrow batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the setting ``spark.checkpoint.dir``, without which nothing can be written."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables of :func:`stored` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        if "/tidemark-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: A key with more than this part of all rows is heavy: there can't be more heavy keys than this.
HEAVY = 4096


def spread_join(rows: DataFrame, right: DataFrame, keys: list[str], weight: str, inner: bool = False) -> DataFrame:
    """A left (or inner) join whose hot keys meet in every task.

    ``right`` has each key once, with the number of rows that it may meet (``weight``).  Keys with more than one in HEAVY
    of the whole weight are HEAVY rows at most, and so are broadcast; all others are joined by a shuffle.
    """
    limit = (right.agg(F.sum(weight)).first()[0] or 0) / HEAVY
    heavy = right.where(F.col(weight) > limit).withColumn("_heavy", F.lit(True))
    near = rows.join(F.broadcast(heavy), keys, "left")
    names = [*keys, *(c for c in rows.columns if c not in keys), *(c for c in right.columns if c not in keys)]
    rest = near.where("_heavy is null").select(*rows.columns).join(right.where(F.col(weight) <= limit), keys, "inner" if inner else "left")
    return near.where("_heavy").select(*names).union(rest.select(*names))


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that batches of very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    # workers on this machine import the package from where the driver has it; on a cluster it is installed
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def bounded_sample(rows: DataFrame, counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of doc_id, whatever the order and the partitions of the table.

    ``counted`` has the same rows, or some more, in columns that are cheap to read; its count sets the share that a hash
    lets through, so that tasks send the driver little more than the sample in all.
    """
    share = min(1.0, 1.2 * most / max(counted.count(), 1))
    key: Column = F.xxhash64("doc_id", F.lit("sample"))
    picked = rows.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    return picked.withColumn("_key", key).orderBy("_key").limit(most).drop("_key")
