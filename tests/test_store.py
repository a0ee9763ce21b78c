"""The on-disk store against a dictionary, over random histories."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.store import Store, StoreLocked

OPS = "position long, k long, op string, v long"


def ops_of(spark, rows):
    return spark.createDataFrame(rows, OPS)


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_history_equals_dictionary(spark, folder, seed):
    rng, model, position = random.Random(seed), {}, 0
    with Store(spark, f"{folder}/s") as store:
        for _ in range(5):
            rows = []
            for _ in range(rng.randint(1, 40)):
                k, put = rng.randint(-15, 15), rng.random() < 0.65
                rows.append((position, k, "PUT" if put else "DELETE", rng.randint(0, 99) if put else None))
                position += 1
            for _, k, op, v in rows:
                model.pop(k, None) if op == "DELETE" else model.__setitem__(k, v)
            rng.shuffle(rows)  # order is by position, never by arrival
            store.commit(ops_of(spark, rows))
            assert content(store.view()) == model
            if rng.random() < 0.5:
                store.compact(everything=rng.random() < 0.3)
                assert content(store.view()) == model
        low, high = -5, 7
        assert content(store.view(low, high)) == {k: v for k, v in model.items() if low <= k <= high}
        assert [r["k"] for r in store.scan(reverse=True).collect()] == sorted(model, reverse=True)
        store.compact(everything=True)
        assert len(store.manifest().runs) <= 1
        assert store.generations().where("is_deleted").count() == 0  # the oldest run took part
        assert content(store.view()) == model


def test_partial_compaction_keeps_tombstones(spark, folder):
    with Store(spark, f"{folder}/s") as store:
        store.commit(ops_of(spark, [(i, i, "PUT", i) for i in range(200)]))
        store.compact(everything=True)
        store.commit(ops_of(spark, [(300, 5, "DELETE", None)]))
        now = store.manifest()
        now.runs[1].bytes = 10**12  # too large to be taken
        store._publish(now)
        assert store.compact() == 1
        assert store.generations().where("is_deleted").count() == 1
        assert not store.contains(5) and store.contains(6)


def test_all_deleted_and_empty(spark, folder):
    with Store(spark, f"{folder}/s") as store:
        assert store.view().count() == 0
        store.commit(ops_of(spark, [(i, i, "PUT", i) for i in range(50)]))
        store.commit(ops_of(spark, [(50 + i, i, "DELETE", None) for i in range(50)]))
        assert store.view().count() == 0
        store.compact(everything=True)
        assert store.view().count() == 0


def test_checkpoints_survive_compaction_and_vacuum(spark, folder):
    with Store(spark, f"{folder}/s") as store:
        store.commit(ops_of(spark, [(0, 1, "PUT", 10), (1, 2, "PUT", 20)]))
        store.checkpoint("a")
        store.commit(ops_of(spark, [(2, 1, "DELETE", None)]))
        store.compact(everything=True)
        assert len(store.vacuum()) == 1  # the delete alone: the checkpoint holds the first generation
        assert content(store.view()) == {2: 20}
        assert content(store.view(checkpoint="a")) == {1: 10, 2: 20}
        assert store.space()["active"] <= store.space()["total"]


def test_one_writer_and_readers(spark, folder):
    with Store(spark, f"{folder}/s") as store:
        store.commit(ops_of(spark, [(0, 1, "PUT", 1)]))
        with pytest.raises(StoreLocked):
            Store(spark, f"{folder}/s")
        reader = Store(spark, f"{folder}/s", read_only=True)
        before = reader.view()
        store.commit(ops_of(spark, [(1, 2, "PUT", 2)]))
        assert content(before) == {1: 1}  # a snapshot
        assert content(reader.view()) == {1: 1, 2: 2}
        with pytest.raises(PermissionError):
            reader.commit(ops_of(spark, [(2, 3, "PUT", 3)]))
    Store(spark, f"{folder}/s").close()


def test_batches_are_committed_once(spark, folder):
    with Store(spark, f"{folder}/s") as store:
        batch = ops_of(spark, [(0, 1, "PUT", 1)])
        assert store.commit(batch, "b0") and not store.commit(batch, "b0")
        assert len(store.manifest().runs) == 1


def test_key_filter_reaches_the_scan(spark, folder):
    with Store(spark, f"{folder}/s") as store:
        store.commit(ops_of(spark, [(i, i, "PUT", i) for i in range(100)]))
        store.commit(ops_of(spark, [(100 + i, 1000 + i, "PUT", i) for i in range(100)]))
        plan = store.view(10, 20)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k,10), LessThanOrEqual(k,20)]" in plan
        assert plan.count("FileScan parquet") == 1  # the other generation's key range misses
        assert store.view().select("k").where(F.col("k") == 1005).count() == 1


def test_large_string_keys(spark, folder):
    with Store(spark, f"{folder}/s", schema="k string, v long") as store:
        rows = [(i, f"{i:05d}" * 400, "PUT", i) for i in range(100)]
        store.commit(spark.createDataFrame(rows, "position long, k string, op string, v long"))
        assert store.get("00042" * 400).first()["v"] == 42
