"""Operation logs as streams: segments of a log folder are committed to stores batch by batch.

A batch is committed under its own id before the stream's checkpoint moves on, so a batch that is run again after a
failure changes nothing.  Order is by position, never by arrival: a stream takes files by their time of modification, which
tasks that write together leave in any order, so a written log gets times in the order of its segments; and of a batch that
comes late all the same, only what is newer than the store's own row of its key is committed.  (Two things need arrival in
order, as nothing kept would tell: a checkpoint operation, and deletes that a full compaction has dropped.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Files
from ..sources.store import Store

LOG = "position long, k long, op string, v long, keys array<long>, ts long"


def write_segments(ops: DataFrame, folder: str, per_segment: int = 1000) -> None:
    """A log folder with a file for each segment of positions."""
    rows = ops.select("position", "k", "op", "v", *(F.col(c) if c in ops.columns else F.lit(None).cast(t).alias(c) for c, t in (("keys", "array<long>"), ("ts", "long"))))
    segment = F.floor(F.col("position") / per_segment)
    rows.withColumn("segment", segment).repartition("segment").sortWithinPartitions("segment", "position").write.partitionBy("segment").parquet(folder)
    _in_order(ops.sparkSession, folder)


def _in_order(spark: SparkSession, folder: str) -> None:
    """Give the files of a new log times of modification in the order of its segments, none later than now."""
    files = Files(spark, folder)
    found = sorted(files.found("segment=[-0-9]*/*.parquet"), key=lambda f: int(f[0].split("/")[0].split("=")[1]))
    last = max((millis for _, millis in found), default=0)
    for back, (name, _) in enumerate(reversed(found)):
        files.touch(name, last - back)


def roll_by_time(ops: DataFrame, folder: str, ts: str = "ts", every: str = "1 day") -> int:
    """A log folder with a segment for each span of time that has operations, numbered in order; returns how many.

    Spans are numbered by their rank among those that there are, so that a reader finds no hole.
    """
    from ..operators.ordered import numbered

    span = F.window(F.col(ts).cast("timestamp"), every)["start"]
    spans = numbered(ops.select(span.alias("span")).distinct(), "span", "segment")
    rows = ops.withColumn("span", span).join(F.broadcast(spans), "span").select("position", "k", "op", "v", (F.col("segment") - 1).alias("segment"))
    rows.repartition("segment").sortWithinPartitions("segment", "position").write.partitionBy("segment").parquet(folder)
    _in_order(ops.sparkSession, folder)
    return spans.count()


def tail(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The log as a stream of rows."""
    return spark.readStream.schema(f"{LOG}, segment long").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def applied(batch: DataFrame, store: Store, name: str) -> None:
    """Commit a batch; where checkpoint operations cut it, the store keeps the state of each under its timestamp."""
    from ..sources.oplog import exploded

    cuts = [(r["position"], r["ts"]) for r in batch.where("op = 'CHECKPOINT'").select("position", "ts").orderBy("position").collect()]
    rows = exploded(batch).select("position", "k", "op", "v")
    first = rows.agg(F.min("position")).first()[0]
    if first is not None and first <= store.manifest().properties.get("position", -1):
        rows = store.unseen(rows)
    low = None
    for n, (position, ts) in enumerate([*cuts, (None, None)]):
        part = rows if low is None else rows.where(F.col("position") > low)
        store.commit(part if position is None else part.where(F.col("position") < position), f"{name}-{n}")
        if position is not None:
            store.checkpoint(str(ts))
            low = position


def ingest(stream: DataFrame, stores: list[Store], checkpoint: str, name: str = "log", also: list[Callable[[DataFrame, int], None]] | None = None, once: bool = True) -> StreamingQuery:
    """Feed each batch to all stores (and other functions).  ``once``: what is there now; else every five seconds."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for store in stores:
                applied(batch, store, f"{name}-{number}")
            for f in also or []:
                f(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def minute_counts(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Events of each minute; on a stream, a minute is given out once the watermark has passed it."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


def lag(store: Store, log: DataFrame, name: str = "log") -> dict[str, int]:
    """How far a store is behind its log: the last position of each."""
    done = store.generations().agg(F.max("position")).first()[0]
    last = log.agg(F.max("position")).first()[0]
    return {"applied": -1 if done is None else done, "written": -1 if last is None else last}


def collected(spark: SparkSession, folder: str, before_segment: int) -> list[str]:
    """Delete segments before one, back to the first hole; returns their names."""
    files = Files(spark, folder)
    have = {int(n.split("=")[1]): n for n in files.names("") if n.startswith("segment=")}
    gone, at = [], before_segment - 1
    while at in have:
        files.delete(have[at])
        gone.append(have[at])
        at -= 1
    return gone
