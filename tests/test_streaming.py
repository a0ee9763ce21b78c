"""Streams into stores: order, replays, checkpoints, fan-out, expiry."""

from pyspark.sql import functions as F

from tidemark.sources.files import Files
from tidemark.sources.store import Store
from tidemark.streaming import ingest, keyed

LOG = "position long, k long, op string, v long, keys array<long>, ts long"


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_log_into_two_stores_with_checkpoints(spark, folder):
    rows = [(0, 1, "PUT", 10, None, None), (1, 2, "PUT", 20, None, None), (2, None, "CHECKPOINT", None, None, 777), (3, None, "DELETE", None, [1, 9], None), (4, 3, "PUT", 30, None, None), (5, 2, "PUT", 21, None, None)]
    ingest.write_segments(spark.createDataFrame(rows, LOG), f"{folder}/log", per_segment=4)
    seen = []
    with Store(spark, f"{folder}/a") as a, Store(spark, f"{folder}/b") as b:
        query = ingest.ingest(ingest.tail(spark, f"{folder}/log", 1), [a, b], f"{folder}/marks", also=[lambda df, n: seen.append(df.count())])
        query.awaitTermination()
        assert content(a.view()) == content(b.view()) == {2: 21, 3: 30}
        assert content(a.view(checkpoint="777")) == {1: 10, 2: 20}
        assert sum(seen) == len(rows)
        assert ingest.lag(a, spark.createDataFrame(rows, LOG)) == {"applied": 5, "written": 5}
        # the same batches again, from a stream that has lost its checkpoint
        ingest.ingest(ingest.tail(spark, f"{folder}/log", 1), [a], f"{folder}/marks2").awaitTermination()
        assert content(a.view()) == {2: 21, 3: 30}
        # more of the log
        ingest.write_segments(spark.createDataFrame([(8, 5, "PUT", 50, None, None)], LOG), f"{folder}/more", per_segment=4)
    assert ingest.collected(spark, f"{folder}/log", 1) == ["segment=0"]


def test_minute_counts_stream(spark, folder):
    times = ["2024-01-01 00:00:10", "2024-01-01 00:00:50", "2024-01-01 00:01:10", "2024-01-01 00:09:00"]
    spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{folder}/e")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{folder}/e")
    query = ingest.minute_counts(stream).writeStream.outputMode("append").format("memory").queryName("minutes").option("checkpointLocation", f"{folder}/m").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n"] for r in spark.sql("SELECT n FROM minutes ORDER BY minute").collect()] == [2, 1]


def test_last_values_with_expiry(spark, folder):
    rows = [(0, 1, "PUT", 5, "2024-01-01 00:00:00"), (1, 1, "PUT", 6, "2024-01-01 00:00:01"), (2, 2, "DELETE", None, "2024-01-01 00:00:02")]
    late = [(3, 3, "PUT", 7, "2024-01-01 09:00:00")]
    for n, part in enumerate((rows, late, [(4, 4, "PUT", 8, "2024-01-01 09:05:00")])):
        spark.createDataFrame(part, "position long, k long, op string, v long, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{folder}/o")
        stream = spark.readStream.schema("position long, k long, op string, v long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/o")
        query = keyed.last_values(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["k"], r["v"], r["op"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert {(1, 6, "PUT"), (2, None, "DELETE"), (3, 7, "PUT"), (1, None, "EXPIRED")} <= got


def test_segments_that_arrive_out_of_order(spark, folder):
    """Positions decide, whatever order files come in: a stream takes them by time of modification."""
    rows = [(p, p % 5, "DELETE" if p % 7 == 3 else "PUT", p if p % 7 != 3 else None, None, None) for p in range(60)]
    live = {}
    for _, k, op, v, *_ in rows:
        live.pop(k, None) if op == "DELETE" else live.__setitem__(k, v)
    ingest.write_segments(spark.createDataFrame(rows, LOG).repartition(7), f"{folder}/log", per_segment=10)
    files = Files(spark, f"{folder}/log")
    names, times = zip(*sorted(files.found("segment=*/*.parquet")), strict=True)
    assert len(times) == 6 and list(times) == sorted(set(times))  # a written log is in order
    for name, back in zip(names, [3, 0, 5, 1, 4, 2], strict=True):  # another writer's isn't
        files.touch(name, times[0] - 1000 * back)
    with Store(spark, f"{folder}/a") as a:
        ingest.ingest(ingest.tail(spark, f"{folder}/log", 1), [a], f"{folder}/marks").awaitTermination()
        assert content(a.view()) == live
        ingest.ingest(ingest.tail(spark, f"{folder}/log", 2), [a], f"{folder}/marks2", name="again").awaitTermination()
        assert content(a.view()) == live
        assert a.manifest().properties["position"] == 59
