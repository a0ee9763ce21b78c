"""Token ids as wavelet matrices: one compressed file for each shard, with access, counting and occurrence lookup.

A wavelet matrix stores the ids of a shard as bit-planes, highest bit first; below each plane the ids are parted by
its bit, zeros before ones.  Counts of ones before each block of bits make rank a lookup plus a popcount, and select a
binary search over those counts.

File: 8 bytes of magic, a little-endian header (ids, documents, planes, block length), for each plane the number of
zeros, the packed bits and the rank counts (all compressed), then doc_ids and offsets of the documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import subwords
from .ragged import blocks
from .session import scratch, small_batches

MAGIC = b"TMWAVE01"
BLOCK = 512
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of ids as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError(f"id {int(ids.max())} needs more than {levels} planes")
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(levels):
            bit = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            low = now[~bit]
            now = np.concatenate([low, now[bit]])
            planes.append(packed)
            zeros.append(len(low))
            ranks.append(cls._counts(packed))
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _counts(packed: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        sums = np.add.reduceat(_POP[packed], np.arange(0, len(packed), step), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
        return np.r_[np.uint32(0), np.cumsum(sums, dtype=np.uint32)]

    def _rank(self, level: int, at: int) -> int:
        """Ones before a position of a plane."""
        block = at // BLOCK
        ones = int(self.ranks[level][block])
        plane = self.planes[level]
        first, last = block * BLOCK // 8, at // 8
        ones += int(_POP[plane[first:last]].sum())
        if at % 8:
            ones += int(_POP[plane[last] & ((1 << (at % 8)) - 1)])
        return ones

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][at // 8] >> (at % 8)) & 1
            ones = self._rank(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, at: int) -> tuple[int, int]:
        a, b = 0, at
        for level in range(len(self.planes)):
            x, y = self._rank(level, a), self._rank(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if value >> (len(self.planes) - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, value: int, at: int) -> int:
        """How often an id stands before a position."""
        if value >> len(self.planes):
            return 0
        a, b = self._range(value, at)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        first = block * BLOCK
        bits = np.unpackbits(self.planes[level][first // 8 : (first + BLOCK) // 8], bitorder="little")[: self.n - first]
        return first + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence: the planes are parted back, lowest bit first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[~bit] = now[: self.zeros[level]]
            up[bit] = now[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            now = up
        return now


def dump(matrix: WaveletMatrix, doc_ids: pa.Array, lengths: np.ndarray) -> bytes:
    """The file of a shard.  A null doc_id is kept as such."""
    pack = zstandard.ZstdCompressor(level=1).compress
    out = [MAGIC, struct.pack("<QQHH", matrix.n, len(lengths), len(matrix.planes), BLOCK)]

    def put(raw: bytes) -> None:
        small = pack(raw)
        out.extend((struct.pack("<QQ", len(small), len(raw)), small))

    for plane, zeros, ranks in zip(matrix.planes, matrix.zeros, matrix.ranks, strict=True):
        out.append(struct.pack("<Q", zeros))
        put(plane.tobytes())
        put(ranks.astype("<u4").tobytes())
    put(np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes())
    put(np.asarray(doc_ids.is_null()).astype(np.uint8).tobytes())
    put(lengths.astype("<i8").tobytes())
    return b"".join(out)


def load(raw: bytes) -> tuple[WaveletMatrix, pa.Array, np.ndarray]:
    """A shard's matrix, doc_ids and lengths of documents from its file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    n, docs, levels, _ = struct.unpack_from("<QQHH", raw, 8)
    at = 8 + struct.calcsize("<QQHH")
    unpack = zstandard.ZstdDecompressor()

    def get() -> bytes:
        nonlocal at
        small, size = struct.unpack_from("<QQ", raw, at)
        at += 16 + small
        return unpack.decompress(raw[at - small : at], max_output_size=size) if size else b""

    planes, zeros, ranks = [], [], []
    for _ in range(levels):
        zeros.append(struct.unpack_from("<Q", raw, at)[0])
        at += 8
        planes.append(np.frombuffer(get(), np.uint8))
        ranks.append(np.frombuffer(get(), "<u4"))
    ids = np.frombuffer(get(), "<i8")
    null = np.frombuffer(get(), np.uint8).view(bool)
    return WaveletMatrix(n, planes, zeros, ranks), pa.array(ids, pa.int64(), mask=null), np.frombuffer(get(), "<i8")[:docs]


SHARD = "shard long, part long, n_ids long, file binary"


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 2, shards: int | None = None, shard_bytes: int = 16 << 20) -> None:
    """Encode all texts in ascending doc_id order and write one wavelet file for each shard under ``out``.

    The files are rows of a binary table, which Spark's writers commit whole or not at all.  ``shard`` counts ranges of
    doc_id, ``part`` the shards of a range.  A null text has the end id alone; null doc_ids come first.  There are as many
    planes as the vocabulary's ids have bits.
    """
    small_batches(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        encoder = subwords.encoder(path, kept=True)
        levels = max(encoder.tokenizer.get_vocab_size() - 1, end_id).bit_length()
        for part, block in enumerate(blocks(batches, "text", shard_bytes)):
            ids, offsets = subwords.with_end(*encoder(block.column("text")), end_id)
            raw = dump(WaveletMatrix.build(ids, levels), block.column("doc_id"), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), part, len(ids), raw)], ["shard", "part", "n_ids", "file"])

    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    placed.mapInArrow(encode, SHARD).write.parquet(out)


def shard_starts(shards: DataFrame) -> DataFrame:
    """shard, part and the ids in all shards before it.  One row for each file; ranges are summed before they meet."""
    from pyspark.sql import Window

    sizes = shards.select("shard", "part", "n_ids")
    whole = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", "part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(whole, "shard").select("shard", "part", (F.col("before") + F.col("inside")).alias("shard_start"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, shard, part, n_tokens, ids_crc32 and the start inside the shard of every document, from the files."""

    def read(batches):
        for batch in batches:
            for shard, part, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "file")), strict=True):
                matrix, doc_ids, lengths = load(raw)
                ids = memoryview(matrix.all().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *(pa.array(x, pa.int64()) for x in (starts, lengths, crc, np.full(len(lengths), shard), np.full(len(lengths), part)))],
                    ["doc_id", "inside", "n_tokens", "ids_crc32", "shard", "part"],
                )

    small_batches(shards.sparkSession)  # a batch ends with the first shard that fills it
    return shards.select("shard", "part", "file").mapInArrow(read, "doc_id long, inside long, n_tokens long, ids_crc32 long, shard long, part long")


def _asked(shards: DataFrame, answer, schema: str) -> DataFrame:
    """Rows that ``answer`` gives for a shard's matrix, doc_ids and documents' ends; one file is open at a time."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("file"):
                matrix, doc_ids, lengths = load(raw.as_py())
                yield from answer(matrix, doc_ids, np.cumsum(lengths))

    return shards.select("file").mapInArrow(run, schema)


def counted(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token and n: how often each id stands in all shards, by rank at the ends of their matrices."""

    def answer(matrix, doc_ids, ends):
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return _asked(shards, answer, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """doc_id and offset (in its document) of each occurrence of an id, by select."""

    def answer(matrix, doc_ids, ends):
        at = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
        doc = np.searchsorted(ends, at, "right")
        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), pa.array(at - np.r_[0, ends][doc])], ["doc_id", "offset"])

    return _asked(shards, answer, "doc_id long, offset long")


def ids_at(shards: DataFrame, offset: int) -> DataFrame:
    """doc_id and token: the id at an offset of each document that is long enough, by access."""

    def answer(matrix, doc_ids, ends):
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        own = np.flatnonzero(starts + offset < ends)
        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(own)), pa.array([matrix.access(int(starts[i]) + offset) for i in own], pa.int64())], ["doc_id", "token"])

    return _asked(shards, answer, "doc_id long, token long")


def encoded(docs: DataFrame, path: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Write the shards of all documents and read them back: doc_id, start, n_tokens and ids_crc32 of each document.

    Ties of doc_id keep a row each, in any order among themselves.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    out = scratch(spark, "wavelet")
    write_shards(docs, path, out, end_id, shards)
    files = spark.read.schema(SHARD).parquet(out)
    found = read_shards(files).join(shard_starts(files), ["shard", "part"])
    return found.select("doc_id", (F.col("inside") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
