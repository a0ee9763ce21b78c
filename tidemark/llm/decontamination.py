"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of a benchmark item (a shorter item is one window).  For each pattern
length m, a table gives for the hash of a block of B words how far a cursor may move on: m - B + 1 where the block
stands in no pattern, else the distance of its last place in a pattern from the pattern's end.  Where the shift is 0,
the hash of the block selects a bucket of patterns, the first word's hash thins it, and the words are compared.
Many cursors move at once, each over its own stretch of a document, as one array.

The benchmark goes to the executors in parts of bounded size, one after the other: the driver and a task hold one part at a
time, and the documents with their hits so far are written between two parts.  Nothing is shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from . import ragged
from .session import dropped, small_batches, stored

#: Bytes of words: 0-9, a-z and all bytes beyond ASCII, after A-Z are lower-cased.
WORD = ragged.byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Text bytes of the benchmark that are searched for in one map.
PART_BYTES = 16 << 20
#: Window ends that one cursor passes over.
STRETCH = 256
#: Words in a block (fewer in patterns as short as that).
BLOCK_WORDS = 3
_STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Patterns:
    """Patterns of one length: the shift table, and the buckets of patterns by the hash of their last block."""

    words: int
    block: int
    shift: np.ndarray
    suffix: np.ndarray  # sorted hashes of last blocks
    prefix: np.ndarray  # hashes of first words, in the order of suffix
    texts: list[bytes]
    items: list[list[int]]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and each row's first word."""
    data, offsets = ragged.text_bytes(texts)
    data = LOWER[data]
    return data, *ragged.spans(data, offsets, WORD)


def _block_hash(hashes: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block of words that ends at each position."""
    h = hashes[last - (block - 1)]
    for k in range(block - 2, -1, -1):
        h = (h * _STEP) ^ hashes[last - k]
        h ^= h >> np.uint64(29)
    return h * _STEP


def _slot(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (len(table) - 1).bit_length())).astype(np.int64)


def compiled(texts: list[str], window: int) -> list[Patterns]:
    """Patterns of these items by length; items are numbered as they come."""
    data, starts, ends, rows = _words(pa.array(texts, pa.large_string()))
    hashes = ragged.span_hash(data, starts, ends)
    raw = data.tobytes()
    found: dict[bytes, tuple[int, set[int]]] = {}
    for item in range(len(texts)):
        a, b = int(rows[item]), int(rows[item + 1])
        size = min(window, b - a)
        for k in range(a, b - size + 1 if size else a):
            text = b" ".join(raw[starts[j] : ends[j]] for j in range(k, k + size))
            found.setdefault(text, (k, set()))[1].add(item)
    out = []
    lengths = {t: t.count(b" ") + 1 for t in found}
    for m in sorted(set(lengths.values())):
        own = [t for t in found if lengths[t] == m]
        first = np.array([found[t][0] for t in own])
        block = min(BLOCK_WORDS, m)
        table = np.full(1 << max(12, (16 * len(own)).bit_length()), m - block + 1, np.uint8)
        for q in range(block, m + 1):  # the block that ends at the q-th word
            h = _block_hash(hashes, first + q - 1, block)
            np.minimum.at(table, _slot(h, table), np.uint8(m - q))
        last = _block_hash(hashes, first + m - 1, block)
        order = np.argsort(last, kind="stable")
        out.append(Patterns(m, block, table, last[order], hashes[first][order], [own[i] for i in order], [sorted(found[own[i]][1]) for i in order]))
    return out


def search(raw: bytes, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Last words of all occurrences of patterns of one length, and which pattern each is."""
    low = rows[:-1] + p.words - 1
    count = np.maximum(rows[1:] - low, 0)
    pieces = -(-count // STRETCH)
    doc = np.repeat(np.arange(len(count)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = low[doc] + k * STRETCH
    stop = np.minimum(at + STRETCH, rows[1:][doc])
    zero = []
    while len(at):
        shift = p.shift[_slot(_block_hash(hashes, at, p.block), p.shift)]
        hit = shift == 0
        zero.append(at[hit])
        at = at + np.maximum(shift, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    at = np.concatenate(zero) if zero else np.zeros(0, np.int64)
    block = _block_hash(hashes, at, p.block)
    a, b = np.searchsorted(p.suffix, block, "left"), np.searchsorted(p.suffix, block, "right")
    at, which = np.repeat(at, b - a), ragged.ranges(a, b - a)
    same = hashes[at - (p.words - 1)] == p.prefix[which]
    at, which = at[same], which[same]
    first = at - (p.words - 1)
    # one space between words is the usual case, and one comparison; else the words are joined first
    tight = (ends[at] - starts[first]) == np.array([len(t) for t in p.texts])[which] if len(at) else np.zeros(0, bool)
    ok = np.zeros(len(at), bool)
    for i, (f, t, w) in enumerate(zip(first.tolist(), at.tolist(), which.tolist(), strict=True)):
        text = raw[starts[f] : ends[t]] if tight[i] else b""
        if text != p.texts[w]:
            text = b" ".join([raw[starts[j] : ends[j]] for j in range(f, t + 1)])
        ok[i] = text == p.texts[w]
    return at[ok], which[ok]


def scan_block(texts: pa.Array, patterns: list[Patterns], old: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; offsets, starts and ends of hit ranges (words of the row); offsets and numbers of items."""
    data, starts, ends, rows = _words(texts)
    hashes = ragged.span_hash(data, starts, ends)
    raw = data.tobytes()
    n = len(starts)
    edge = np.zeros(n + 1, np.int64)
    if old is not None and len(old.flatten()):
        lengths = old.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        base = np.repeat(rows[:-1], lengths)
        for field, sign in (("start", 1), ("end", -1)):
            np.add.at(edge, base + old.flatten().field(field).to_numpy(zero_copy_only=False), sign)
    pairs = []
    for p in patterns:
        at, which = search(raw, starts, ends, rows, hashes, p)
        np.add.at(edge, at - (p.words - 1), 1)
        np.add.at(edge, at + 1, -1)
        doc = np.searchsorted(rows, at, "right") - 1
        several = np.array([len(x) for x in p.items])
        item = np.array([i for x in p.items for i in x], np.int64)[ragged.ranges((np.cumsum(several) - several)[which], several[which])] if len(at) else at
        pairs.append(np.stack([np.repeat(doc, several[which]), item], 1) if len(at) else np.zeros((0, 2), np.int64))
    pair = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    hit = np.cumsum(edge[:-1]) > 0
    first, last = hit.copy(), hit.copy()
    if n:
        first[1:] &= ~hit[:-1]
        last[:-1] &= ~hit[1:]
        filled = rows[1:] > rows[:-1]
        first[rows[:-1][filled]] = hit[rows[:-1][filled]]
        last[rows[1:][filled] - 1] = hit[rows[1:][filled] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(rows, begin, "right") - 1
    bounds = np.searchsorted(begin, rows, "left")
    return np.diff(rows), bounds, begin - rows[doc], end - rows[doc], np.searchsorted(pair[:, 0], np.arange(len(rows))), pair[:, 1], hashes


_compiled: dict[str, list[Patterns]] = {}


def _patterns(part: Broadcast, window: int) -> list[Patterns]:
    """This worker's tables of the part of the benchmark that it searches for now."""
    key = part.value[0]
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = compiled(part.value[2], window)
    return _compiled[key]


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES):
    """The benchmark in parts (a key, item ids as strings, texts) of about ``part_bytes`` at most, one at a time."""
    size = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-int(size) // part_bytes), 1)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toPandas()
        yield uuid.uuid4().hex, rows["item"].where(rows["item"].notna(), None).tolist(), rows["text"].tolist(), k == n - 1


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, part_bytes: int = PART_BYTES, block_bytes: int = 4 << 20, name: str = "hits") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``name``: n_words, ranges of hit words, items that occur in it.

    A null text has no words.  Items without words, and null texts of items, match nothing; an item without an id
    hits words but isn't listed.  Repeated rows give repeated results, repeated items hit together; texts of any length are
    searched whole.  An empty benchmark leaves all documents without hits.  A column called ``name`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if name in docs.columns:
        docs = docs.drop(name)
    kind = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def scan(part, first: bool):
        def run(batches):
            patterns = _patterns(part, window)
            ids = pa.array(part.value[1], pa.string())
            for block in ragged.blocks(batches, "text", block_bytes):
                old = None if first else block.column(name)
                n_words, bounds, begin, end, item_bounds, items, _ = scan_block(block.column("text"), patterns, None if first else old.field("ranges"))
                ranges = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["start", "end"]))
                found = pa.ListArray.from_arrays(pa.array(item_bounds, pa.int32()), ids.take(pa.array(items)))
                if not first:
                    found = pa.array([[*a, *b] for a, b in zip(old.field("items").to_pylist(), found.to_pylist(), strict=True)], pa.list_(pa.string()))
                hits = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), ranges, found], ["n_words", "ranges", "items"])
                columns = {c: block.column(c) for c in block.schema.names if c != name} | {name: hits}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return run

    out, first = docs, True
    for *part, last in benchmark_parts(benchmark, part_bytes):
        shared = spark.sparkContext.broadcast(part)
        before, out = out, out.mapInArrow(scan(shared, first), schema)
        if not last:
            out = stored(out, "benchmark-hits")
            shared.destroy()
            if not first:
                dropped(spark, before)
        first = False
    return out


def contamination(hits: DataFrame, name: str = "hits", share: int = 20) -> DataFrame:
    """Digest of :func:`benchmark_hits`: contaminated if any word is hit, and at least one in ``share`` of all words."""
    n_hit = F.aggregate(f"{name}.ranges", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]))
    items = F.array_sort(F.array_distinct(F.filter(f"{name}.items", lambda x: x.isNotNull())))
    out = hits.select("doc_id", F.col(f"{name}.n_words").alias("n_words"), n_hit.alias("n_hit"), items.alias("items"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
