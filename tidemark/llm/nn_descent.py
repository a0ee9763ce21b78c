"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Rows with one vector are one node, so copies cost nothing.  Nodes get first neighbours from blocks of a few random
projections.  In each round of NN-descent the neighbours of a node, forward and reverse, are compared with each other
(but for pairs that it compared the round before), and every node keeps the best of what it had and what it was offered.  Nodes are dealt to parts; a join brings each
part the vectors that its nodes' neighbours need, once, as bytes; the comparisons are small matrix products in tasks.

Queries start at their own node and at the longest nodes.  In each step all nodes of the beam that haven't been expanded
are, by joins with the graph and the vectors, and the best stay in the beam, until a beam has no such node.  The last beam
is ranked by the vectors themselves, in double precision.

Largest inner product is reduced to nearness in the graph by one more coordinate, which gives all vectors one length L;
queries have none.  It is kept apart from the vector's bytes, as what it lacks to L, so that long vectors of the table
don't coarsen others.  The rounds' tables are written, so lost executors cost one round at most.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .jaccard_join import _groups
from .session import dropped, small_batches, stored

#: Nodes compared with each other at first, and projections.
LEAF, TREES = 256, 4
#: Bytes of vectors that a part's nodes may want, queries that a part has at most, and the least number of parts.
PART_BYTES, QUERIES, PARTS = 128 << 20, 512, 8
#: Rounds go on until fewer than this share of the lists' entries are new.
SETTLED = 0.05
#: Longest nodes at which queries start too.
LONGEST = 64
GRAPH = "id long, ids array<long>, scores array<float>"


def packed_vectors(x: np.ndarray, lack: np.ndarray, length: float) -> list[bytes]:
    """Vectors as signed bytes, after their scale, what the added coordinate lacks to ``length``, and that times it."""
    scale = (np.maximum(np.abs(x).max(1), 1e-30) / 127).astype("<f4")
    table = np.empty((len(x), 12 + x.shape[1]), np.uint8)
    table[:, :12] = np.stack([scale, lack, lack * length], 1).astype("<f4").view(np.uint8)
    table[:, 12:] = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8).view(np.uint8)
    return [row.tobytes() for row in table]


class Codes:
    """Packed vectors of a column, which are unpacked where they are asked for."""

    def __init__(self, column: pa.Array):
        table = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        self.scale, self.lack, self.offset = np.ascontiguousarray(np.ascontiguousarray(table[:, :12]).view("<f4").T)
        self.bytes = table[:, 12:].view(np.int8)

    def __getitem__(self, at) -> np.ndarray:
        return self.bytes[at].astype(np.float32) * self.scale[at, None]

    def products(self, at, first: int | None = None) -> np.ndarray:
        """Inner products of the lengthened vectors (of the ``first`` of them) with each other, less the square of their length."""
        x, lack, offset = self[at], self.lack[at], self.offset[at]
        out = x[:first] @ x.T
        out += lack[:first, None] * lack - offset[:first, None] - offset
        return out


def unpacked(column: pa.Array) -> np.ndarray:
    return Codes(column)[:]


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vectors take part: not null, not zero, all components finite, of the most common length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and vec_id is not null")
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def encoded(nodes: DataFrame) -> DataFrame:
    """id and code: the vector, and what the coordinate that gives all one length lacks to it, as bytes."""
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    longest = nodes.agg(F.max(squared)).first()[0] or 0.0

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("embedding").flatten()).reshape(batch.num_rows, -1)
                square, length = (x * x).sum(1), math.sqrt(longest)
                lack = square / (length + np.sqrt(np.maximum(longest - square, 0)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed_vectors(x, lack, length), pa.binary())], ["id", "code"])

    return nodes.select("id", "embedding").mapInArrow(encode, "id long, code binary")


def _lists(ids: np.ndarray, left: np.ndarray, right: np.ndarray, score: np.ndarray, most: int) -> pa.RecordBatch:
    """For each left row its best right rows, without repeats."""
    order = np.lexsort((right, -score, left))
    left, right, score = left[order], right[order], score[order]
    _, once = np.unique(left.astype(np.int64) << 32 | right, return_index=True)
    keep = np.zeros(len(left), bool)
    keep[once] = True
    left, right, score = left[keep], right[keep], score[keep]
    heads = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
    rank = np.arange(len(left)) - np.repeat(heads, np.diff(np.r_[heads, len(left)]))
    keep = rank < most
    left, right, score = left[keep], right[keep], score[keep]
    heads = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
    bounds = pa.array(np.r_[heads, len(left)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids[left[heads]]), pa.ListArray.from_arrays(bounds, pa.array(ids[right])), pa.ListArray.from_arrays(bounds, pa.array(score, pa.float32()))], ["id", "ids", "scores"])


def first_lists(codes: DataFrame, neighbours: int, seed: int = 5) -> DataFrame:
    """Lists from blocks of LEAF nodes that follow each other in a random projection; a block has any nodes at most once."""

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("code"))
                random = np.random.default_rng(seed).standard_normal((TREES, x.shape[1], 9)).astype(np.float32)
                for t in range(TREES):
                    p = x @ random[t]
                    side = (p[:, :8] > 0) @ (1 << np.arange(8))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(side + 1 / (1 + np.exp(-p[:, 8].astype(float)))), batch.column("id"), batch.column("code")], ["tree", "place", "id", "code"])

    def compare(batches):
        def leaf(rows: list[pa.RecordBatch]):
            block = pa.concat_batches(rows)
            ids = block.column("id").to_numpy()
            same = block.column("tree").to_numpy()
            score = Codes(block.column("code")).products(slice(None))
            left, right = np.nonzero((same[:, None] == same) & ~np.eye(len(ids), dtype=bool))
            return _lists(ids, left, right, score[left, right], neighbours)

        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, LEAF - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == LEAF:
                    yield leaf(held)
                    held, size = [], 0
        if size:
            yield leaf(held)

    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = codes.mapInArrow(place, "tree int, place double, id long, code binary")
    return placed.repartitionByRange(n, "tree", "place").sortWithinPartitions("tree", "place").mapInArrow(compare, GRAPH)


def merged(lists: DataFrame, neighbours: int) -> DataFrame:
    """The best of all lists of a node."""

    def merge(batches):
        for group in _groups(batches, ["id"]):
            ids, score = group.column("ids").flatten().to_numpy(), group.column("scores").flatten().to_numpy()
            ids, first = np.unique(ids, return_index=True)
            score = score[first]
            best = np.lexsort((ids, -score))[:neighbours]
            yield [group.column("id")[0].as_py(), ids[best].tolist(), score[best].tolist()]

    def batched(batches):
        rows = []
        for row in merge(batches):
            rows.append(row)
            if len(rows) == 2000:
                yield _graph_batch(rows)
                rows = []
        if rows:
            yield _graph_batch(rows)

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(n, "id").sortWithinPartitions("id").mapInArrow(batched, GRAPH)


def _graph_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], ["id", "ids", "scores"])


def both_ways(graph: DataFrame, reverse: int) -> DataFrame:
    """id and near: its neighbours, and the best ``reverse`` of the nodes that have it as a neighbour."""
    edges = graph.select("id", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select(F.col("e.ids").alias("to"), "id", F.col("e.scores").alias("score"))
    best = Window.partitionBy("to").orderBy(F.desc("score"), "id")
    back = edges.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= reverse).groupBy("to").agg(F.collect_list("id").alias("back"))
    return graph.join(back.withColumnRenamed("to", "id"), "id", "left").select("id", F.array_distinct(F.concat("ids", F.coalesce("back", F.array().cast("array<long>")))).alias("near"), F.element_at("scores", -1).alias("worst"), F.size("ids").alias("size"))


def improved(graph: DataFrame, codes: DataFrame, parts: int, neighbours: int, reverse: int, last: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: every node offers its neighbours to each other.  The lists after it, and the neighbours that were compared.

    Two neighbours that the node had in the round before (``last``) were offered then, and lists only get better since: so
    only pairs with a neighbour that is new to the node are compared, which finds the same.
    """
    near = both_ways(graph, reverse).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    if last is None:
        near = near.withColumn("fresh", F.size("near"))
    else:
        fresh = F.array_except("near", F.coalesce("old", F.array().cast("array<long>")))
        near = near.join(last.select("id", F.col("near").alias("old")), "id", "left").withColumn("new", fresh)
        near = near.withColumn("near", F.concat("new", F.array_except("near", "new"))).withColumn("fresh", F.size("new")).drop("old", "new")
    near = stored(near, "nn-near")
    floor = near.select("id", F.when(F.col("size") >= neighbours, F.col("worst")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
    active = near.where("fresh > 0")
    wanted = active.select("part", F.explode("near").alias("id")).distinct()
    none = F.lit(None)
    vectors = wanted.join(codes.join(floor, "id"), "id").select("part", "id", "code", "worst", none.cast("array<long>").alias("near"), none.cast("int").alias("fresh"))
    lists = active.select("part", "id", none.cast("binary"), none.cast("float"), "near", "fresh")

    def compare(batches):
        for group in _groups(batches, ["part"]):
            is_vector = group.column("code").is_valid().to_numpy(zero_copy_only=False)
            have, lists = group.filter(pa.array(is_vector)), group.filter(pa.array(~is_vector))
            ids = have.column("id").to_numpy()
            order = np.argsort(ids)
            codes, worst = Codes(have.column("code")), have.column("worst").to_numpy()
            spot = order[np.searchsorted(ids[order], lists.column("near").flatten().to_numpy())]
            ends = np.r_[0, np.cumsum(lists.column("near").value_lengths().to_numpy())]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b, fresh in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.column("fresh").to_pylist(), strict=True):
                own = spot[a:b]
                score, least = codes.products(own, fresh), worst[own]
                np.fill_diagonal(score, -np.inf)
                new, other = np.nonzero(score > least[:fresh, None])
                found.append((own[new], own[other], score[new, other]))
                new, other = np.nonzero(score[:, fresh:] > least[fresh:])
                found.append((own[fresh + other], own[new], score[new, fresh + other]))
            if found:
                yield _lists(ids, *(np.concatenate([f[k] for f in found]) for k in range(3)), neighbours)

    offers = vectors.union(lists).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(compare, GRAPH)
    return merged(graph.union(offers), neighbours), near


def neighbour_graph(codes: DataFrame, count: int, neighbours: int = 40, reverse: int = 60, rounds: int | None = None) -> DataFrame:
    """The best ``neighbours`` found of every node: rounds go on until lists hardly change (at most ``rounds``, if given)."""
    spark = codes.sparkSession
    width = codes.select(F.max(F.octet_length("code"))).first()[0] or 0
    parts = max(PARTS, -(-count * (neighbours + reverse) * (width + 16) // PART_BYTES))  # a node wants its neighbours' vectors once
    graph = stored(merged(first_lists(codes, neighbours), neighbours), "nn-graph")
    near = None
    while rounds is None or rounds > 0:
        better, compared = improved(graph, codes, parts, neighbours, reverse, near)
        before, graph = graph, stored(better, "nn-graph")
        if near is not None:
            dropped(spark, near)
        near = compared
        news = graph.join(before.select("id", F.col("ids").alias("old")), "id").agg(F.sum(F.size(F.array_except("ids", "old"))).alias("n"), F.sum(F.size("ids")).alias("all")).first()
        dropped(spark, before)
        if (news["n"] or 0) < SETTLED * (news["all"] or 1):
            break
        rounds = None if rounds is None else rounds - 1
    if near is not None:
        dropped(spark, near)
    return graph


def searched(graph: DataFrame, codes: DataFrame, starts: DataFrame, count: int, more: list[int], beam: int = 128, reverse: int = 60) -> DataFrame:
    """query, and the ids of its beam, after greedy search from the nodes ``starts`` (id), and ``more``; a query is a node."""
    parts = max(PARTS, -(-count // QUERIES))
    near = stored(both_ways(graph, reverse).select("id", F.array_distinct(F.concat(F.array("id"), "near")).alias("near")), "nn-search")
    first = F.array(*(F.lit(i).cast("long") for i in more)).cast("array<long>")
    state = starts.join(codes, "id").select(
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.col("id").alias("query"), "code",
        F.array_distinct(F.concat(F.array("id"), first)).alias("beam"), F.array().cast("array<float>").alias("scores"), F.array().cast("array<long>").alias("done"),
    )
    none = F.lit(None)
    kind = "part int, query long, code binary, beam array<long>, scores array<float>, done array<long>"

    def step(batches):
        for group in _groups(batches, ["part"]):
            kinds = group.column("kind").to_numpy()
            states, lists, vectors = (group.filter(pa.array(kinds == k)) for k in range(3))
            ids = vectors.column("id").to_numpy()
            order = np.argsort(ids)
            ids, codes = ids[order], Codes(vectors.column("code").take(pa.array(order))) if len(ids) else None
            nodes = lists.column("id").to_numpy()
            order = np.argsort(nodes)
            nodes = nodes[order]
            flat = np.searchsorted(ids, lists.column("beam").flatten().to_numpy())
            ends = np.r_[0, np.cumsum(lists.column("beam").value_lengths().to_numpy())]
            rows = []
            for r in states.to_pylist():
                beam_ids, score, done = np.array(r["beam"], np.int64), np.array(r["scores"], np.float32), np.array(r["done"], np.int64)
                fresh = np.setdiff1d(beam_ids, done)
                at = order[np.searchsorted(nodes, fresh)] if len(nodes) else np.zeros(0, np.int64)
                seen = [flat[ends[i] : ends[i + 1]] for i in at.tolist()]
                own = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
                q = np.frombuffer(r["code"], np.int8, offset=12).astype(np.float32) * np.frombuffer(r["code"], "<f4", 1)
                new = codes[own] @ q if len(own) else np.zeros(0, np.float32)
                held = beam_ids[: len(score)]  # the first beam has no scores yet; its nodes stand in their own lists
                all_ids, first = np.unique(np.r_[ids[own], held], return_index=True)
                all_scores = np.r_[new, score][first]
                keep = all_ids != r["query"]
                all_ids, all_scores = all_ids[keep], all_scores[keep]
                best = np.lexsort((all_ids, -all_scores))[:beam]
                rows.append(r | {"beam": all_ids[best].tolist(), "scores": all_scores[best].tolist(), "done": np.union1d(done, fresh).tolist()})
            if rows:
                names = [c.split()[0] for c in kind.split(", ")]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    open_ = F.size(F.array_except("beam", "done")) > 0
    ended = []
    while True:
        state = stored(state, "nn-state")
        ended.append(state.where(~open_).select("query", "beam"))
        state = state.where(open_)
        if state.isEmpty():
            return functools.reduce(DataFrame.union, ended)
        fresh = state.select("part", F.explode(F.array_except("beam", "done")).alias("id")).distinct()
        lists = fresh.join(near, "id").select("part", "id", "near")
        wanted = lists.select("part", F.explode("near").alias("id")).distinct().join(codes, "id")
        rows = state.select("part", F.lit(0).alias("kind"), F.col("query").alias("id"), "query", "code", "beam", "scores", "done")
        rows = rows.union(lists.select("part", F.lit(1), "id", none.cast("long"), none.cast("binary"), "near", none.cast("array<float>"), none.cast("array<long>")))
        rows = rows.union(wanted.select("part", F.lit(2), "id", none.cast("long"), "code", none.cast("array<long>"), none.cast("array<float>"), none.cast("array<long>")))
        state = rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(step, kind)


def nearest(rows: DataFrame, every: int = 20, k: int = 20, ranked: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id.  Rows with equal vectors are found together, through the smallest ids among them
    (k + 1 are enough for any query).  Vectors that are null, zero, of another length than most, or that hold null or
    non-finite components take no part.  Fewer candidates than ``k`` give fewer rows; repeated rows count once, as
    queries and as candidates.
    """
    small_batches(rows.sparkSession, rows=10_000)
    rows = stored(usable(rows).dropDuplicates(["vec_id", "embedding"]), "nn-rows")
    nodes = stored(rows.groupBy("embedding").agg(F.min("vec_id").alias("id")), "nn-nodes")
    codes = stored(encoded(nodes), "nn-codes")
    count = nodes.count()
    members = stored(rows.join(nodes, "embedding").select("id", "vec_id"), "nn-members")
    graph = neighbour_graph(codes, count)
    queries = members.where(F.col("vec_id") % every == 0).select("id", F.col("vec_id").alias("query_id"))
    starts = stored(queries.select("id").distinct(), "nn-starts")
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    longest = [r["id"] for r in nodes.orderBy(F.desc(squared), "id").select("id").limit(LONGEST).collect()]
    beams = searched(graph, codes, starts, starts.count(), longest)
    # the beam and the query's own node, by the vectors themselves
    pairs = beams.select("query", F.explode(F.concat(F.array("query"), F.slice("beam", 1, ranked))).alias("id"))
    product = F.aggregate(F.zip_with("a", "embedding", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    vectors = nodes.select(F.col("id").alias("query"), F.col("embedding").alias("a"))
    close = pairs.join(nodes, "id").join(vectors, "query").select("query", "id", product.alias("score"))
    small = Window.partitionBy("id").orderBy("vec_id")
    firsts = members.withColumn("n", F.row_number().over(small)).where(F.col("n") <= k + 1).select("id", "vec_id")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = close.join(firsts, "id").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    answers = stored(answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")), "nn-answers")
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(answers.withColumnRenamed("query", "id"), "id").select("query_id", F.posexplode(own).alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
