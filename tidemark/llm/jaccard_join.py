"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts become sets of word shingles and MinHash signatures of 16-bit values.  Copies of a text are one class from the
start.  Texts that agree on a band of values are candidates.  The values of a candidate pair are compared some at a
time: with a uniform prior, k matches among n values leave a Beta(1 + k, 1 + n - k) posterior of the similarity, and
the pair is dropped once the probability of reaching the threshold falls below the tolerance.  What is left is
verified on the shingle sets.

Buckets of a bounded size are compared inside a task.  Larger ones aren't expanded: those that share texts are a crowd,
whose texts are dealt to blocks, and pairs of blocks of signatures (of a bounded size) are compared, so that only pairs that the
Bayesian look keeps join texts to a group.  Groups are split into blocks of a bounded number of bytes, and each pair of
blocks is a task's unit of work, which gives counts of links and a spanning forest, never pairs.  In a forest all nodes hang on
the smallest of their tree, so edges from different blocks and bands collapse.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ragged
from .components import components
from .session import small_batches, spread_join, stored

HASHES, BAND = 100, 4
#: Texts of a bucket that a task compares with each other, texts of a block of a larger group, and bytes of its shingles.
BLOCK, CROWD, SET_BYTES = 256, 1024, 8 << 20
#: Rows of a block that are compared with another block at a time.
STRIP = 128
#: MinHash values compared between two looks at the posterior.
LOOK = 10
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_STEP = np.uint64(0x9FB21C651E98DF25)


def needed(threshold: float, tolerance: float) -> np.ndarray:
    """Fewest matches among LOOK, 2 LOOK, ... values with which a pair goes on."""
    def reach(k: int, n: int) -> float:  # of Beta(1 + k, 1 + n - k), as a sum over Binomial(n + 1, threshold)
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(k + 1))

    return np.array([next((k for k in range(n + 1) if reach(k, n) >= tolerance), n + 1) for n in range(LOOK, HASHES + 1, LOOK)])


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, with repeats, and offsets.  A text of fewer words is one shingle."""
    data, offsets = ragged.text_bytes(texts)
    starts, ends, rows = ragged.spans(data, offsets, ragged.NOT_SPACE)
    h = ragged.span_hash(data, starts, ends)
    count = np.diff(rows)
    number = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = ragged.ranges(rows[:-1], number)
    size = np.repeat(np.minimum(count, words), number)
    out = size.astype(np.uint64)
    for k in range(words):
        use = size > k
        out = np.where(use, (out ^ h[np.where(use, first + k, 0)]) * _STEP if len(h) else out, out)
        out ^= out >> np.uint64(29)
    return ragged.mix(out), np.r_[0, np.cumsum(number)]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (rows: texts with shingles; 0 elsewhere)."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint16)
    filled = offsets[1:] > offsets[:-1]
    if filled.any():
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        heads = offsets[:-1][filled]
        rows = np.flatnonzero(filled)
        for i in range(HASHES):
            out[rows, i] = np.minimum.reduceat(x * _A[i] + _B[i], heads) & np.uint32(0xFFFF)
    return out


def survivors(left: np.ndarray, right: np.ndarray, same: bool, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that the Bayesian look at more and more values doesn't drop."""
    first = np.zeros((len(left), len(right)), np.uint8)
    for i in range(LOOK):
        first += left[:, i, None] == right[None, :, i]
    keep = first >= least[0]
    if same:
        keep &= np.arange(len(right)) > np.arange(len(left))[:, None]
    a, b = np.nonzero(keep)
    match = first[a, b].astype(np.int64)
    for look in range(1, len(least)):
        if not len(a):
            break
        part = slice(look * LOOK, (look + 1) * LOOK)
        match = match + (left[a, part] == right[b, part]).sum(1)
        live = match >= least[look]
        a, b, match = a[live], b[live], match[live]
    return a, b


def forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a graph over nodes with these ids: each node, and the smallest id of its tree."""
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low]
        if (low[root] == root).all():
            break
        root = low[root]
    least = ids.copy()
    np.minimum.at(least, root, ids)
    edge = np.flatnonzero(least[root] != ids)
    return ids[edge], least[root[edge]]


def strips(left: np.ndarray, right: np.ndarray, same: bool, least: np.ndarray):
    """Surviving pairs of two signature blocks, some rows of the left one at a time."""
    for at in range(0, len(left), STRIP):
        part = left[at : at + STRIP]
        if same:
            a, b = survivors(part, right[at:], True, least)
            yield a + at, b + at
        else:
            a, b = survivors(part, right, False, least)
            yield a + at, b


def joined(left: np.ndarray, right: np.ndarray, same: bool, least: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forest of the pairs that survive among ``ids``: those of the left block, then (unless ``same``) the right one's."""
    base = 0 if same else len(left)
    edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in strips(left, right, same, least):
        edges.append((np.r_[edges[-1][0], a], np.r_[edges[-1][1], b + base]))
        if len(edges[-1][0]) > 1 << 20:  # what is joined already needs few edges
            x, y = forest(*edges[-1], np.arange(len(ids)))
            edges.append((x, y))
        edges = edges[-1:]
    return forest(*edges[-1], ids)


def _groups(batches, keys: list[str]):
    """Record batches sorted by ``keys`` as one batch for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        turn = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            turn |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[x] for c in columns)
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = key
    if held:
        yield pa.concat_batches(held)


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def signed(docs: DataFrame, words: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, digest of the text, number of shingles (with repeats) and signature of every text."""
    small_batches(docs.sparkSession)

    def sign(batches):
        for block in ragged.blocks(batches, "text", block_bytes):
            hashes, offsets = shingles(block.column("text"), words)
            raw = signatures(hashes, offsets).tobytes()
            sig = pa.array([raw[i : i + 2 * HASHES] for i in range(0, len(raw), 2 * HASHES)], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("digest"), pa.array(np.diff(offsets)), sig], ["doc_id", "digest", "n_shingles", "sig"])

    rows = docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.mapInArrow(sign, "doc_id long, digest binary, n_shingles long, sig binary")


def _bands(batches):
    """A row for each band of a text: its number and values, and the text's class."""
    n = HASHES // BAND
    for batch in batches:
        if batch.num_rows:
            keys = np.ascontiguousarray(_matrix(batch.column("sig"), np.uint16, HASHES)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(keys.reshape(-1)), batch.column("class").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))],
                ["band", "key", "class"],
            )


def near_groups(classes: DataFrame, least: np.ndarray) -> DataFrame:
    """id and component: a superset of the classes that near copies link, from bands of signatures."""
    bands = classes.select("class", "sig").mapInArrow(_bands, "band int, key long, class long")
    buckets = stored(bands.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("class").alias("first")).where("size > 1"), "jaccard-buckets")
    members = stored(bands.join(buckets, ["band", "key"]), "jaccard-members")
    stars = members.where(F.col("size") > BLOCK).where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))

    def compare(batches):
        for group in _groups(batches, ["band", "key"]):
            sig = _matrix(group.column("sig"), np.uint16, HASHES)
            a, b = joined(sig, sig, True, least, group.column("class").to_numpy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    small = members.where(F.col("size") <= BLOCK).select("band", "key", "class").join(classes.select("class", "sig"), "class")
    pairs = small.repartition("band", "key").sortWithinPartitions("band", "key").mapInArrow(compare, "a long, b long")
    crowds = components(stars, "jaccard-crowds").withColumnRenamed("id", "class")
    size = stored(crowds.groupBy("component").agg(F.count("*").alias("size"), F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")), "jaccard-sizes")
    placed = spread_join(crowds, size, ["component"], "size", inner=True).join(classes.select("class", "sig"), "class").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))

    def compare_blocks(batches):
        for group in _groups(batches, ["component", "i", "j"]):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            at, ids = group.column("block").to_numpy(), group.column("class").to_numpy()
            sig = _matrix(group.column("sig"), np.uint16, HASHES)
            x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
            a, b = joined(sig[x], sig[y], i == j, least, ids[x] if i == j else ids[np.r_[x, y]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    crowded = _block_pairs(placed.select("class", "sig", "component", "blocks", "block")).mapInArrow(compare_blocks, "a long, b long")
    return components(pairs.union(crowded), "jaccard-near")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of a group's blocks once for each pair of blocks i <= j, sorted by component, i and j."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    pairs = rows.select("*", other).withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_other", "blocks")
    return pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")


def verified(groups: DataFrame, docs: DataFrame, words: int, threshold: float, least: np.ndarray) -> DataFrame:
    """Edges of forests of the links inside groups of classes, and link counts: rows of a, b and is_count."""
    none = F.lit(-(2**63))
    size = groups.groupBy("component").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / CROWD), F.ceil(F.sum("n_shingles") * 8 / SET_BYTES)).cast("int").alias("blocks"))
    placed = spread_join(groups, stored(size, "jaccard-sizes"), ["component"], "size", inner=True).select(F.col("id").alias("node"), F.coalesce("first", none).alias("key"), "component", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))

    def sets(batches):
        for block in ragged.blocks(batches, "text", 8 << 20):
            hashes, offsets = shingles(block.column("text"), words)
            sig = signatures(hashes, offsets)
            own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("node"), block.column("component"), block.column("blocks"), block.column("block"), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(own, pa.large_binary()).cast(pa.binary())],
                ["id", "component", "blocks", "block", "sig", "shingles"],
            )

    texts = docs.select(F.coalesce("doc_id", none).alias("key"), "text", text_node().alias("node"))
    found = texts.join(placed, ["key", "node"]).mapInArrow(sets, "id long, component long, blocks int, block int, sig binary, shingles binary")

    def verify(batches):
        for group in _groups(batches, ["component", "i", "j"]):
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            at = group.column("block").to_numpy()
            ids = group.column("id").to_numpy()
            once = np.zeros(len(ids), bool)  # a repeated row comes more than once
            once[np.unique(ids, return_index=True)[1]] = True
            x, y = np.flatnonzero(once & (at == i)), np.flatnonzero(once & (at == j))
            sig = _matrix(group.column("sig"), np.uint16, HASHES)
            own = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            links = np.zeros(len(ids), np.int64)
            near, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a, b in strips(sig[x], sig[y], i == j, least):
                a, b = x[a], y[b]
                ok = np.zeros(len(a), bool)
                for lo, hi in _runs(a):
                    ok[lo:hi] = _similar(own[a[lo]], [own[k] for k in b[lo:hi].tolist()], threshold)
                a, b = a[ok], b[ok]
                links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
                near, far = forest(np.r_[near, a], np.r_[far, b], np.arange(len(ids)))
            has = np.flatnonzero(links)
            a, b = forest(near, far, ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[has], a]), pa.array(np.r_[links[has], b]), pa.array(np.r_[np.ones(len(has), bool), np.zeros(len(a), bool)])], ["a", "b", "is_count"])

    return _block_pairs(found).mapInArrow(verify, "a long, b long, is_count boolean")


def _runs(values: np.ndarray):
    """Limits of the runs of equal values."""
    if len(values):
        cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)].tolist()
        yield from zip(cuts, cuts[1:], strict=False)


def _similar(own: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of a sorted set and each of the others reaches the threshold."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = ragged.row_sums(own[at] == flat, np.r_[0, np.cumsum(sizes)])
    return both >= threshold * (len(own) + sizes - both) - 1e-9


def text_node(text="text"):
    """A number for each distinct text: a hash of its digest."""
    return F.xxhash64(F.unhex(F.sha2(text, 256)))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links, n_copies and node (of :func:`text_node`) of every row.

    Classes are the connected components of links between texts whose shingle sets have at least this similarity;
    exact copies share a class.  n_links counts the other texts linked to a row's text, n_copies the rows with that
    text.  Null texts and texts without words stay alone: their own class, no links, one copy.  Repeated rows give
    repeated results; a class without any doc_id has a null class_id.
    """
    least = needed(threshold, tolerance)
    rows = stored(signed(docs, words).withColumn("node", F.xxhash64("digest")), "jaccard-rows")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes, "jaccard-classes")
    groups = near_groups(classes.select(F.col("node").alias("class"), "sig"), least)
    firsts = groups.join(classes.select(F.col("node").alias("id"), "first", "n_shingles"), "id")
    found = stored(verified(firsts, docs, words, threshold, least), "jaccard-links")
    links = found.where("is_count").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links"))
    linked = components(found.where("not is_count").select("a", "b"), "jaccard-linked").withColumnRenamed("id", "node")
    linked = linked.join(classes.select("node", "first"), "node")
    names = stored(linked.groupBy("component").agg(F.min("first").alias("class_id"), F.count("*").alias("size")), "jaccard-names")
    named = spread_join(linked, names, ["component"], "size", inner=True).select("node", "class_id")
    full = classes.select("node", "first", "n_copies").join(named, "node", "left").join(links, "node", "left")
    alone = F.col("n_shingles") == 0
    return spread_join(rows.select("doc_id", "n_shingles", "node"), stored(full, "jaccard-full"), ["node"], "n_copies").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_id", "first")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"), "node",
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: the one with the smallest doc_id.

    Repeated rows leave one.  Texts without words all stay; classes without any doc_id keep one row.
    """
    none = F.lit(-(2**63))
    rows = stored(near_duplicates(docs, **options).withColumn("key", F.coalesce("doc_id", none)), "jaccard-choice")
    late = rows.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("key").alias("_late"), F.col("node").alias("_late_node")).distinct()
    left = docs.withColumns({"_key": F.coalesce("doc_id", none), "_node": text_node()})
    kept = left.join(late, (F.col("_key") == F.col("_late")) & F.col("_node").eqNullSafe(F.col("_late_node")), "left_anti")
    again = rows.where("n_copies > 1").groupBy("key", "node").count().where("count > 1").limit(1).count()
    if again:  # a row and its own copies
        filled = kept.where(F.trim(F.coalesce("text", F.lit(""))) != "")
        kept = filled.dropDuplicates(["_key", "_node"]).union(kept.where(F.trim(F.coalesce("text", F.lit(""))) == ""))
    return kept.drop("_key", "_node")
