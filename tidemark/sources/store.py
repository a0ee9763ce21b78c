"""A keyed table of sorted Parquet generations under an atomic manifest.

``manifests/N.json`` lists the generations of version N, newest first, each with its folder, key range, counts and
bytes; the largest N is the current state.  A commit writes one generation and publishes the next manifest.  Readers
plan on the files of one manifest, so they see a snapshot; files go only by ``vacuum``.  Generations are read with the
key filter below the merge, and those whose key range misses the filter aren't read at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators import lookup, merge, ranges
from .files import Files


@dataclass
class Run:
    """A generation: where it lies, whether a commit wrote it (volatile) or a compaction, and what it holds."""

    folder: str
    volatile: bool
    entries: int
    tombstones: int
    bytes: int
    low: object
    high: object
    position: int | None = None  # the last one


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    runs: list[Run] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parse(cls, text: str) -> Manifest:
        got = json.loads(text)
        return cls(**(got | {"runs": [Run(**r) for r in got["runs"]]}))


class StoreLocked(RuntimeError):
    pass


class Store:
    """``key`` and ``value`` columns k and v; k must sort, and v may be anything (deletes have their own flag)."""

    #: Ids of streaming batches that a manifest remembers.
    REMEMBERED = 1000

    def __init__(self, spark: SparkSession, root: str, schema: str | None = "k long, v long", read_only: bool = False, bloom: bool = True):
        self.spark, self.root, self.read_only, self.bloom = spark, root.rstrip("/"), read_only, bloom
        self.files = Files(spark, root)
        self.owner = uuid.uuid4().hex
        if not read_only and not self.files.create("write.lock", self.owner):
            raise StoreLocked(f"{root} has a writer; if that has died, unlock() first")
        if not read_only and not self.files.names("manifests"):
            self.files.publish("manifests/0000000000.json", Manifest(schema=schema).text())

    @staticmethod
    def unlock(spark: SparkSession, root: str) -> None:
        """Remove the lock of a writer that is known to be dead."""
        Files(spark, root).delete("write.lock")

    def close(self) -> None:
        if not self.read_only and self.files.exists("write.lock") and self.files.read("write.lock") == self.owner:
            self.files.delete("write.lock")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def manifest(self, checkpoint: str | None = None) -> Manifest:
        """The current manifest, or a checkpoint's."""
        if checkpoint is not None:
            return Manifest.parse(self.files.read(f"checkpoints/{checkpoint}.json"))
        return Manifest.parse(self.files.read(f"manifests/{self.files.names('manifests')[-1]}"))

    def _publish(self, manifest: Manifest) -> None:
        if self.read_only:
            raise PermissionError("this store is open for reading")
        manifest.version += 1
        if not self.files.publish(f"manifests/{manifest.version:010d}.json", manifest.text()):
            raise StoreLocked(f"version {manifest.version} was published by another writer")

    def _fields(self) -> T.StructType:
        return T.StructType([*T._parse_datatype_string(self.manifest().schema).fields, T.StructField("is_deleted", T.BooleanType()), T.StructField("position", T.LongType())])

    def _write(self, rows: DataFrame, volatile: bool) -> Run | None:
        """One generation: range-partitioned and sorted by key, so that row groups have narrow key ranges."""
        folder = f"data/{uuid.uuid4().hex}"
        seen = Observation()
        placed = rows.select("k", "v", "is_deleted", "position").repartitionByRange("k").sortWithinPartitions("k")  # small parts are joined at run time
        placed = placed.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("is_deleted").alias("dead"), F.min("k").alias("low"), F.max("k").alias("high"), F.max("position").alias("position"))
        placed.write.option("parquet.bloom.filter.enabled#k", str(self.bloom).lower()).parquet(f"{self.root}/{folder}")
        seen = seen.get
        if not seen["n"]:
            self.files.delete(folder)
            return None
        plain = lambda x: x if isinstance(x, int | float | str) else None  # noqa: E731  other keys aren't pruned by
        return Run(folder, volatile, seen["n"], seen["dead"], self.files.size(folder), plain(seen["low"]), plain(seen["high"]), seen["position"])

    def commit(self, ops: DataFrame, batch: str | None = None) -> bool:
        """Apply operations (position, k, op, v; unique positions) as one generation: of each key the last one counts.

        A batch id that was committed before is ignored, so a repeated streaming batch changes nothing.
        """
        now = self.manifest()
        if batch is not None and batch in now.batches:
            return False
        rows = merge.newest(ops.where(F.col("op").isin("PUT", "DELETE")), ["k"], F.desc("position")).withColumn("is_deleted", F.col("op") == "DELETE")
        run = self._write(rows.withColumn("v", F.when(~F.col("is_deleted"), F.col("v"))), volatile=True)
        now.runs = [*([run] if run else []), *now.runs]
        if run and run.position is not None:
            now.properties["position"] = max(run.position, now.properties.get("position", run.position))
        now.batches = [*now.batches, *([batch] if batch is not None else [])][-self.REMEMBERED :]
        self._publish(now)
        return True

    def unseen(self, ops: DataFrame) -> DataFrame:
        """Operations but those that the store has a newer one of their key for, by position: what a late commit may hold."""
        have = self.state().select("k", F.col("position").alias("_have"))
        return ops.join(have, "k", "left").where(F.col("_have").isNull() | (F.col("position") >= F.col("_have"))).select(*ops.columns)

    def generations(self, low=None, high=None, manifest: Manifest | None = None) -> DataFrame:
        """Rows of all generations with ``gen`` (0: newest); runs outside of [low, high] are left out."""
        manifest = manifest or self.manifest()
        fields = self._fields()
        near = lambda r: r.low is None or ((high is None or r.low <= high) and (low is None or r.high >= low))
        parts = [self.spark.read.schema(fields).parquet(f"{self.root}/{r.folder}").withColumn("gen", F.lit(g)) for g, r in enumerate(manifest.runs) if near(r)]
        if not parts:
            return self.spark.createDataFrame([], fields).withColumn("gen", F.lit(0))
        return reduce(DataFrame.union, parts).withColumn("op", F.when(F.col("is_deleted"), "DELETE").otherwise("PUT"))

    def state(self, low=None, high=None, checkpoint: str | None = None) -> DataFrame:
        """Newest row of each key, deletes included."""
        rows = self.generations(low, high, self.manifest(checkpoint) if checkpoint else None)
        if "op" not in rows.columns:
            rows = rows.withColumn("op", F.lit("PUT"))
        if low is not None:
            rows = rows.where(F.col("k") >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col("k") <= F.lit(high))
        return merge.merged(rows)

    def view(self, low=None, high=None, checkpoint: str | None = None) -> DataFrame:
        """The live entries k, v, as of now or of a checkpoint."""
        return merge.live(self.state(low, high, checkpoint)).select("k", "v")

    def get(self, key) -> DataFrame:
        return self.view(key, key)

    def contains(self, key) -> bool:
        return self.get(key).select("k").limit(1).count() > 0

    def multi_get(self, requested: DataFrame) -> DataFrame:
        return lookup.multi_get(self.view(), requested)

    def scan(self, low=None, high=None, reverse: bool = False, order: Column | None = None) -> DataFrame:
        return ranges.scan(self.view(low, high), reverse, order=order)

    def checkpoint(self, name: str) -> None:
        """Keep the current state under a name (once published it doesn't change)."""
        self.files.publish(f"checkpoints/{name}.json", self.manifest().text())

    def checkpoints(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names("checkpoints")]

    def compact(self, everything: bool = False) -> int:
        """Fold the newest runs into one; returns how many.  Deletes go only if the oldest run takes part."""
        now = self.manifest()
        n = len(now.runs) if everything else merge.tiered([(r.volatile, r.bytes) for r in now.runs])
        if n < 2 and not (n == 1 and (now.runs[0].volatile or everything)):
            return 0
        oldest = n == len(now.runs)
        part = Manifest(runs=now.runs[:n])
        state = merge.merged(self.generations(manifest=part))
        run = self._write(merge.live(state) if oldest else state, volatile=False)
        now.runs = [*([run] if run else []), *now.runs[n:]]
        self._publish(now)
        return n

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete folders that neither a checkpoint nor one of the last versions names.  Older readers may need them."""
        versions = self.files.names("manifests")
        manifests = [Manifest.parse(self.files.read(f"manifests/{n}")) for n in versions[-keep_versions:]] + [self.manifest(c) for c in self.checkpoints()]
        used = {r.folder for m in manifests for r in m.runs}
        gone = [f for f in (f"data/{n}" for n in self.files.names("data")) if f not in used]
        for folder in gone:
            self.files.delete(folder)
        for name in versions[:-keep_versions]:
            self.files.delete(f"manifests/{name}")
        return gone

    def space(self) -> dict[str, int]:
        """Bytes of the current generations, and of all files."""
        return {"active": sum(r.bytes for r in self.manifest().runs), "total": self.files.size("")}
