"""Operators against Python's own bisect, zlib, itertools and dictionaries."""

import bisect
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addresses, codecs
from tidemark.operators import bloom, cache, iterops, lookup, merge, neighbors, ordered, ranges
from tidemark.sources import oplog


@pytest.fixture(scope="module")
def keys():
    return sorted(random.Random(3).sample(range(1000), 150))


def test_neighbors(spark, keys):
    live = spark.createDataFrame([(k,) for k in keys], "k long")
    asked = [*range(-3, 1005), 5, 5, None]
    probes = spark.createDataFrame([(p,) for p in asked], "p long")
    want = {
        "floor": lambda p: keys[i - 1] if (i := bisect.bisect_right(keys, p)) else None,
        "lower": lambda p: keys[i - 1] if (i := bisect.bisect_left(keys, p)) else None,
        "ceil": lambda p: keys[i] if (i := bisect.bisect_left(keys, p)) < len(keys) else None,
        "higher": lambda p: keys[i] if (i := bisect.bisect_right(keys, p)) < len(keys) else None,
    }
    for kind, f in want.items():
        got = [(r["p"], r["found"]) for r in neighbors.neighbors(live, probes, kind).collect()]
        assert sorted(got, key=repr) == sorted(((p, None if p is None else f(p)) for p in asked), key=repr)
    assert neighbors.neighbors(live.where("false"), probes, "floor").where("found is not null").count() == 0


def test_ordered(spark):
    rng = random.Random(1)
    values = [(k, rng.randint(0, 3)) for k in rng.sample(range(500), 120)]
    rows = spark.createDataFrame(values, "k long, v long")
    ordered_values = sorted(values)
    assert [(r["k"], r["n"]) for r in ordered.numbered(rows, "k").orderBy("k").collect()] == [(k, i + 1) for i, (k, _) in enumerate(ordered_values)]
    assert [r["w"] for r in ordered.lagged(rows, "k", "v", "w").orderBy("k").collect()] == [None, *[v for _, v in ordered_values[:-1]]]
    assert [r["s"] for r in ordered.running_sum(rows, "k", F.col("v"), "s").orderBy("k").collect()] == list(itertools.accumulate(v for _, v in ordered_values))


def test_sequences(spark):
    rng = random.Random(2)
    values = sorted((k, rng.randint(0, 2)) for k in rng.sample(range(300), 60))
    rows = spark.createDataFrame(values, "k long, v long")
    first, rest = iterops.span(rows, "k", F.col("v") < 2)
    prefix = list(itertools.takewhile(lambda x: x[1] < 2, values))
    assert sorted(map(tuple, first.collect())) == prefix and sorted(map(tuple, rest.collect())) == values[len(prefix) :]
    groups = [(g[0][1], g[0][0], g[-1][0], len(g)) for _, it in itertools.groupby(values, key=lambda x: x[1]) for g in [list(it)]]
    assert [(r["v"], r["first"], r["last"], r["n"]) for r in iterops.adjacent_groups(rows, "k", "v").orderBy("first").collect()] == groups
    assert [r["chunk"] for r in iterops.chunks(rows, "k", 7).orderBy("k").collect()] == [i // 7 for i in range(60)]
    mixed = [r["v"] for r in iterops.interspersed(rows, "k", "v", 9).orderBy("place").collect()]
    assert mixed == [x for _, v in values for x in (9, v)][1:]
    lists = spark.createDataFrame([(2, [5, 6]), (1, [4]), (3, [])], "g long, x array<long>")
    assert [r["value"] for r in iterops.intercalated(lists, "g", "x", [0, 0]).orderBy("place").collect()] == [4, 0, 0, 5, 6, 0, 0]
    acc = 0
    for _, v in values:
        acc = (acc * 31 + v) % 1009
    assert iterops.affine_fold(rows, "k", "v", 31, 1009).first()["fold"] == acc
    assert [r["k"] for r in iterops.merge(rows, rows).collect()] == sorted(k for k, _ in values for _ in (0, 1))


def test_ranges_nest_and_reverse(spark):
    rows = spark.createDataFrame([(k, k) for k in range(50)], "k long, v long")
    view = ranges.slice_(ranges.slice_(rows, 5, False, 40, True), 3, True, 12, False)
    assert sorted(r["k"] for r in view.collect()) == list(range(6, 12))
    assert [r["k"] for r in ranges.scan(rows, reverse=True, start=9, inclusive=False).collect()] == list(range(8, -1, -1))
    assert [r["k"] for r in ranges.page(rows, 41, 5).collect()] == [42, 43, 44, 45, 46]
    assert [r["k"] for r in ranges.scan(rows.where("k < 12"), order=F.col("k").cast("string")).collect()] == [0, 1, 10, 11, *range(2, 10)]


def test_merge_recency_and_tombstones(spark):
    rows = spark.createDataFrame([(0, 9, 1, "DELETE", None), (1, 3, 1, "PUT", 5), (1, 4, 2, "PUT", 6), (0, 8, 2, "PUT", 7), (2, 1, 3, "DELETE", None)], "gen int, position long, k long, op string, v long")
    assert [(r["k"], r["v"]) for r in merge.live(merge.merged(rows)).collect()] == [(2, 7)]
    assert merge.compacted(rows, [0, 1], False).count() == 2 and merge.compacted(rows, [0, 1], True).count() == 1
    assert merge.tiered([(True, 5), (True, 6), (False, 21), (False, 80)]) == 3
    assert merge.tiered([(True, 5), (False, 11), (False, 1)]) == 1
    assert merge.tiered([]) == 0


def test_lookups(spark):
    state = spark.createDataFrame([(1, "PUT", 10), (2, "DELETE", None), (3, "PUT", 30)], "k long, op string, v long")
    asked = spark.createDataFrame([(1,), (1,), (2,), (4,)], "k long")
    live = merge.live(state)
    assert {r["p"]: r["is_deleted"] for r in lookup.tristate(state, asked.select(F.col("k").alias("p")).distinct()).collect()} == {1: False, 2: True, 4: None}
    assert {r["k"]: r["v"] for r in lookup.get_all(live, asked).collect()} == {1: 10, 2: None, 4: None}
    answers = cache.read_through(asked, live.where("k = 3").select("k", "v"), live)
    assert tuple(cache.stats(answers).first()) == (3, 0, 1, 2)
    index = spark.createDataFrame([(1, 100), (3, 100), (5, 200)], "k long, address long")
    log = spark.createDataFrame([(100, 1, 7)], "address long, k long, v long")
    assert [tuple(r) for r in lookup.indirect(index, log).collect()] == [(1, 100, 7)]
    assert {r["k"]: r["error"] for r in lookup.streamed(index, log, index).collect()} == {1: None, 3: "wrong key", 5: "missing"}


def test_logs(spark):
    rows = spark.createDataFrame([(i, s, i) for i, s in enumerate([0, 0, 1, 3, 3, 4])], "position long, segment long, k long")
    assert oplog.before_gap(rows).count() == 3
    assert oplog.before_gap(rows.where("segment > 1")).count() == 3  # a log may start late
    assert oplog.before_first(rows, F.col("position") == 2).count() == 2
    assert oplog.before_first(rows, F.col("position") == 99).count() == 6
    deletes = spark.createDataFrame([(0, None, [3, 4]), (1, 7, None)], "position long, k long, keys array<long>")
    assert sorted((r["position"], r["k"]) for r in oplog.exploded(deletes).collect()) == [(0, 3), (0, 4), (1, 7)]


def test_addresses_round_trip_and_order(spark):
    rows = addresses.addressed(spark.range(5000).withColumnRenamed("id", "position"))
    a = F.col("address")
    back = rows.select("position", "segment", "block", "record", "address", addresses.segment(a).alias("s"), addresses.block(a).alias("b"), addresses.record(a).alias("r"), addresses.segment_path(F.lit(1234567)).alias("path")).orderBy("position").collect()
    assert all((r["s"], r["b"], r["r"]) == (r["segment"], r["block"], r["record"]) for r in back)
    assert all(x["address"] < y["address"] for x, y in itertools.pairwise(back))
    assert back[0]["path"] == "001/234/001234567.rec"


def test_codecs(spark):
    payloads = [b"", b"abc", bytes(range(99))]
    got = spark.createDataFrame([(p,) for p in payloads], "p binary").select(codecs.record_crc(F.col("p")).alias("c")).collect()
    assert [r["c"] for r in got] == [zlib.crc32(bytes.fromhex("C2A3066E") + p) for p in payloads]
    rows = spark.createDataFrame([([5, 3, 3, 100],), ([],), ([-7],)], "x array<long>").select("x", codecs.delta_encoded(F.col("x")).alias("d")).withColumn("y", codecs.delta_decoded(F.col("d"))).collect()
    assert [r["d"] for r in rows] == [[5, -2, 0, 97], [], [-7]] and all(r["x"] == r["y"] for r in rows)


def test_sequences_of_groups(spark):
    rng = random.Random(8)
    values = sorted({(rng.choice([1, 1, 1, 2, 5]), rng.randrange(500)) for _ in range(200)}) + [(9, 7)]
    rows = spark.createDataFrame([(None, 3), *values], "g long, x long").repartition(3)
    lists = [[3], *([x for _, x in it] for _, it in itertools.groupby(values, key=lambda r: r[0]))]
    got = iterops.intercalated_rows(rows, "g", "x", [-1, -2]).orderBy("place").collect()
    assert [r["value"] for r in got] == [x for part in lists for x in (-1, -2, *part)][2:]
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))
    coded = iterops.deltas(rows, "g", "x")
    want = [(None, 3, 3)] + [(g, x, x - (before[1] if before[0] == g else 0)) for before, (g, x) in itertools.pairwise([(None, 3), *values])]
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(want, key=repr)
    back = iterops.undeltas(coded.withColumn("key", F.struct("g", "x")), "key", "g", "delta", "y").collect()
    assert len(back) == len(want) and all(r["x"] == r["y"] for r in back)
    empty = rows.where("false")
    assert iterops.intercalated_rows(empty, "g", "x", [0]).count() == iterops.deltas(empty, "g", "x").count() == 0
    filled = spark.createDataFrame([(i, i if i % 40 == 5 else None) for i in range(200)], "k long, v long").repartition(5)
    assert [r["f"] for r in ordered.carried(filled, "k", "v", "f").orderBy("k").collect()] == [None if i < 5 else (i - 5) // 40 * 40 + 5 for i in range(200)]


def test_bloom(spark):
    keys, others = spark.range(3000).withColumnRenamed("id", "k"), spark.range(100_000, 103_000).withColumnRenamed("id", "k")
    table = bloom.built(keys)
    assert bloom.maybe(keys, table).where("not maybe").count() == 0
    assert bloom.maybe(others, table).where("maybe").count() < 150
    assert bloom.maybe(others, bloom.built(keys.where("false"))).where("maybe").count() == 0
