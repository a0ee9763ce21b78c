"""Removal of passages that an earlier document has, by prefix-partitioned suffix trees.

Suffixes are taken where a repeat must have one: a window is a run of consecutive words, and its least word n-gram (its
anchor) is the same in equal windows.  The suffixes that start at one anchor have its n-gram as their prefix, and form a
group; a run of words around the anchor holds all windows that it belongs to.  Prefixes that stand in one document only
can't hold a repeat and are left out.  Where a group has more bytes than a task should hold, its windows go on by
themselves, with a prefix that grows step by step (``STEPS``) until a group is small enough or in one document; at
the window's whole length the prefix is itself a node of the tree.

A task builds the suffix tree of each of its groups: the order of its suffixes by doubled ranks, the words that
neighbours share, and from these the internal nodes, each with a depth and an interval of leaves.  Nodes at least as
deep as a window are the repeats: each has the smallest doc_id below it, and a leaf of a larger one starts a window to
be removed.  Runs of such windows make up the maximal repeats of a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import ragged
from .jaccard_join import _groups
from .session import small_batches, spread_join, stored

#: Words in the n-gram that is a group's shortest prefix.
GRAM = 10
#: Bytes of words in a group above which its prefix grows, and the lengths that it grows to before the whole window.
GROUP_BYTES, STEPS = 1 << 20, (20, 35)
_STEP = np.uint64(0x9FB21C651E98DF25)
_ORDER = np.uint64(0xFFFFFFFFFF000000)


def _words(texts: pa.Array):
    data, offsets = ragged.text_bytes(texts)
    return data, *ragged.spans(data, offsets, ragged.NOT_SPACE)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the n-gram that starts at each word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = (h * _STEP) ^ hashes[k : k + n]
        h ^= h >> np.uint64(29)
    return ragged.mix(h)


def anchors(hashes: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor words, hashes of their n-grams, first window and number of windows of each group of windows of a text."""
    gram = _grams(hashes, GRAM)
    width = window - GRAM + 1
    n = len(gram) - width + 1
    count = np.maximum(np.diff(rows) - window + 1, 0)
    if n <= 0 or not count.any():
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    least = np.empty(n, np.int64)
    room = int(~_ORDER) + 1  # positions that fit beside a hash; longer blocks are taken in stretches, which overlap by a window
    for low in range(0, n, room - width + 1):
        part = gram[low : low + room]
        key = (part & _ORDER) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        m = len(part) - width + 1
        least[low : low + m] = low + (np.minimum(key[:m], key[width - size : width - size + m]) & ~_ORDER).astype(np.int64)
    starts = ragged.ranges(rows[:-1], count)
    at = least[starts]
    head = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(head)
    return at[first], gram[at[first]], starts[first], np.diff(np.r_[first, len(at)])


def anchored(docs: DataFrame, window: int, block_bytes: int = 8 << 20) -> DataFrame:
    """A row for each anchor of a text: prefix, doc_id, text_key and its runs of windows (first and number, as pairs of int32).

    A text that repeats a phrase has the same anchor many times, but one row for it.
    """

    def run(batches):
        for block in ragged.blocks(batches, "text", block_bytes):
            data, starts, ends, rows = _words(block.column("text"))
            at, gram, first, number = anchors(ragged.span_hash(data, starts, ends), rows, window)
            doc = np.searchsorted(rows, at, "right") - 1
            order = np.lexsort((first, gram, doc))
            gram, doc = gram[order], doc[order]
            pairs = np.stack([first[order] - rows[doc], number[order]], 1).astype("<i4").tobytes()
            heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])]) if len(at) else np.zeros(0, np.int64)
            limits = (8 * np.r_[heads, len(at)]).tolist()
            own = pa.array(doc[heads])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[heads].view(np.int64)), block.column("doc_id").take(own), block.column("text_key").take(own), pa.array([pairs[i:j] for i, j in zip(limits, limits[1:], strict=False)], pa.binary())],
                ["prefix", "doc_id", "text_key", "runs"],
            )

    return docs.mapInArrow(run, "prefix long, doc_id long, text_key long, runs binary")


SPAN = "array<struct<first:int,end:int>>"
SUFFIX = f"prefix long, doc_id long, text_key long, first int, number int, words binary, prefixes array<long>, whole binary, spans {SPAN}"
SUFFIX_NAMES = ["prefix", "doc_id", "text_key", "first", "number", "words", "prefixes", "whole", "spans"]


def suffixes(docs: DataFrame, window: int, block_bytes: int = 8 << 20) -> DataFrame:
    """The words of each shared run, for groups that a task can hold; or a row for each of its windows, with its longer
    prefixes and the spans that it covers in the text.

    ``docs`` has an array ``anchors`` of prefix, runs and long.
    """

    def run(batches):
        for block in ragged.blocks(batches, "text", block_bytes):
            data, starts, ends, rows = _words(block.column("text"))
            raw = data.tobytes()
            lists = block.column("anchors")
            flat = lists.flatten()
            runs = flat.field("runs").to_pylist()
            several = np.array([len(r) // 8 for r in runs], np.int64)
            doc = np.repeat(np.repeat(np.arange(block.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), several)
            prefix, long = (np.repeat(flat.field(f).to_numpy(zero_copy_only=False), several) for f in ("prefix", "long"))
            first, number = np.frombuffer(b"".join(runs), "<i4").reshape(-1, 2).T.astype(np.int64)
            base = rows[doc] + first
            short = np.flatnonzero(~long)
            text = [raw[starts[a] : ends[b]] for a, b in zip(base[short].tolist(), (base[short] + number[short] + window - 2).tolist(), strict=True)]
            n, row = len(short), pa.array(doc[short])
            no = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([pa.array(prefix[short]), block.column("doc_id").take(row), block.column("text_key").take(row), pa.array(first[short], pa.int32()), pa.array(number[short], pa.int32()), pa.array(text, pa.binary()), *no], SUFFIX_NAMES)
            far = np.flatnonzero(long)
            if len(far):
                at = ragged.ranges(base[far], number[far])
                own = doc[np.repeat(far, number[far])]
                seen: dict[bytes, int] = {}
                code = np.array([seen.setdefault(hashlib.blake2b(b" ".join([raw[starts[j] : ends[j]] for j in range(a, a + window)]), digest_size=16).digest(), len(seen)) for a in at.tolist()])
                # a window that a text repeats is one row, with the spans that it covers there
                order = np.lexsort((at, code, own))
                at, own, code = at[order], own[order], code[order]
                group = np.r_[True, (own[1:] != own[:-1]) | (code[1:] != code[:-1])]
                span = group | np.r_[True, at[1:] > at[:-1] + window]
                heads, tails = np.flatnonzero(span), np.r_[np.flatnonzero(span)[1:], len(at)] - 1
                lead = np.flatnonzero(group)
                names = list(seen)
                row = rows[own[heads]]
                covered = pa.StructArray.from_arrays([pa.array(at[heads] - row, pa.int32()), pa.array(at[tails] + window - row, pa.int32())], ["first", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(heads, np.r_[lead, len(at)]), pa.int32()), covered)
                hashes = ragged.span_hash(data, starts, ends)
                longer = np.stack([_grams(hashes, k)[at[lead]].view(np.int64) for k in STEPS], 1)
                prefixes = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1) * len(STEPS), pa.int32()), pa.array(longer.reshape(-1)))
                text = [raw[starts[a] : ends[a + window - 1]] for a in at[lead].tolist()]
                n, row = len(lead), pa.array(own[lead])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), block.column("doc_id").take(row), block.column("text_key").take(row), pa.array(at[lead] - rows[own[lead]], pa.int32()), pa.array(np.ones(n), pa.int32()), pa.array(text, pa.binary()), prefixes, pa.array([names[c] for c in code[lead].tolist()], pa.binary()), lists],
                    SUFFIX_NAMES,
                )

    return docs.mapInArrow(run, SUFFIX)


class SuffixTree:
    """The suffix tree of runs of words: leaves in order, and internal nodes with their depth and interval of leaves."""

    def __init__(self, symbols: np.ndarray, rows: np.ndarray):
        """``symbols``: numbers of the words of all runs, one run after the other; ``rows``: limits of the runs."""
        n = len(symbols)
        self.limit = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)  # words to the run's end
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.ranks, size = [rank], 1
        longest = int(self.limit.max(initial=0))
        while size < longest:
            after = np.full(n, -1, np.int64)  # a run's end differs from all other ends
            inside = np.flatnonzero(self.limit > size)
            after[inside] = rank[inside + size]
            ends = np.flatnonzero(self.limit <= size)
            after[ends] = -1 - ends
            order = np.lexsort((after, rank))
            turn = np.r_[True, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])] if n else np.zeros(0, bool)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(turn) - 1
            rank, size = new, size * 2
            self.ranks.append(rank)
            if n and int(rank.max()) == n - 1:
                break
        self.leaves = np.argsort(rank, kind="stable")
        a, b = self.leaves[:-1].copy(), self.leaves[1:].copy()
        shared = np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            size, ranks = 1 << level, self.ranks[level]
            ok = (a < n) & (b < n)
            ok[ok] = (self.limit[a[ok]] >= size) & (self.limit[b[ok]] >= size) & (ranks[a[ok]] == ranks[b[ok]])
            ok &= (shared + size <= self.limit[self.leaves[:-1]]) & (shared + size <= self.limit[self.leaves[1:]])
            shared[ok] += size
            a[ok] += size
            b[ok] += size
        self.shared = shared  # words that a leaf has in common with the next one

    def deep(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First leaf and end of the highest internal nodes of at least this depth."""
        joined = np.r_[False, self.shared >= depth, False]
        return np.flatnonzero(~joined[:-1] & joined[1:]), np.flatnonzero(joined[:-1] & ~joined[1:]) + 1

    def nodes(self, depth: int) -> list[tuple[int, int, int]]:
        """Depth, first leaf and end of all internal nodes of at least this depth."""
        out = []
        for low, high in zip(*self.deep(depth), strict=True):
            stack = [(int(self.shared[low]), int(low))]
            for i in range(low + 1, high):
                d = int(self.shared[i]) if i < high - 1 else depth - 1
                first = i
                while stack and stack[-1][0] > d:
                    level, first = stack.pop()
                    out.append((level, first, i + 1))
                if d >= depth and (not stack or stack[-1][0] < d):
                    stack.append((d, first))
        return out

    def maximal_repeats(self, symbols: np.ndarray, rows: np.ndarray, depth: int) -> list[tuple[int, list[int]]]:
        """Length and places of the repeats of at least this depth that can't be made longer at either side."""
        start = np.isin(np.arange(len(symbols)), rows)
        out = []
        for level, low, high in self.nodes(depth):
            at = self.leaves[low:high]
            before = {-1 - i if start[i] else int(symbols[i - 1]) for i in at.tolist()}
            if len(before) > 1:
                out.append((level, sorted(at.tolist())))
        return out


def _tree(groups) -> tuple[SuffixTree, np.ndarray, np.ndarray]:
    """The tree of a task's groups, its runs' limits and the number of each suffix's run."""
    data, starts, ends, rows = _words(pa.chunked_array([g.column("words") for g in groups]).combine_chunks())
    symbols = pd.factorize(ragged.span_hash(data, starts, ends))[0]
    return SuffixTree(symbols, rows), rows, np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def _late(groups, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs, and places in them, of windows that a smaller doc_id in the tree has too."""
    tree, rows, owner = _tree(groups)
    doc_id = np.concatenate([g.column("doc_id").to_numpy() for g in groups])
    first, end = tree.deep(window)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = tree.leaves[ragged.ranges(first, end - first)]
    heads = np.r_[0, np.cumsum(end - first)[:-1]]
    smallest = np.repeat(np.minimum.reduceat(doc_id[owner[at]], heads), end - first)
    late = at[doc_id[owner[at]] > smallest]
    return owner[late], late - rows[owner[late]]


def _by_bytes(batches, limit: int):
    """The rows of one or more whole groups, about ``limit`` bytes of words at a time."""
    held, size = [], 0
    for group in _groups(batches, ["prefix"]):
        held.append(group)
        size += group.column("words").nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _spans_of(found: DataFrame) -> DataFrame:
    """doc_id, text_key and all spans of words to be removed there, which may overlap."""
    return found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("gone"))


def earlier_repeats(docs: DataFrame, window: int = 50, tree_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, text_key and spans of words of windows that also start in a document with a smaller doc_id."""
    docs = docs.select("doc_id", "text_key", "text").where("doc_id is not null and text is not null")
    rows = stored(anchored(docs, window), "substring-anchors")
    size = F.sum(F.octet_length("runs") / 8 * 12 * window)  # a run has about as many windows as a window has words, and a word six bytes
    shared = rows.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), size.alias("size")).where("low < high")
    runs = rows.join(shared.select("prefix", (F.col("size") > GROUP_BYTES).alias("long")), "prefix")
    by_doc = runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("prefix", "runs", "long")).alias("anchors"))
    found = stored(suffixes(docs.join(by_doc, ["doc_id", "text_key"]), window), "substring-suffixes")

    def of_runs(batches):
        for groups in _by_bytes(batches, tree_bytes):
            run, at = _late(groups, window)
            doc_id, text_key = (np.concatenate([g.column(c).to_numpy() for g in groups])[run] for c in ("doc_id", "text_key"))
            at = at + np.concatenate([g.column("first").to_numpy() for g in groups])[run]
            order = np.lexsort((at, text_key, doc_id))
            doc_id, text_key, at = doc_id[order], text_key[order], at[order]
            cut = np.r_[True, (doc_id[1:] != doc_id[:-1]) | (text_key[1:] != text_key[:-1]) | (at[1:] > at[:-1] + 1)] if len(at) else np.zeros(0, bool)
            head, tail = np.flatnonzero(cut), np.r_[np.flatnonzero(cut)[1:], len(at)] - 1
            for k in range(0, len(head), 100_000):
                a, b = head[k : k + 100_000], tail[k : k + 100_000]
                span = pa.StructArray.from_arrays([pa.array(at[a], pa.int32()), pa.array(at[b] + window, pa.int32())], ["first", "end"])
                yield pa.RecordBatch.from_arrays([pa.array(doc_id[a]), pa.array(text_key[a]), pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1), pa.int32()), span)], ["doc_id", "text_key", "spans"])

    def of_windows(batches):
        for groups in _by_bytes(batches, tree_bytes):
            run = pa.array(np.unique(_late(groups, window)[0]))
            rows_ = pa.Table.from_batches(groups).select(["doc_id", "text_key", "spans"]).take(run)
            yield from rows_.to_batches()

    kind = f"doc_id long, text_key long, spans {SPAN}"
    out = found.where("whole is null").select("prefix", "doc_id", "text_key", "first", "words").repartition(_tasks(found), "prefix").sortWithinPartitions("prefix").mapInArrow(of_runs, kind)
    left = found.where("whole is not null")
    for k in range(len(STEPS)):  # prefixes grow; what is left after the last step is as long as the window
        left = left.withColumn("prefix", F.get("prefixes", F.lit(k)))
        sizes = left.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("size")).where("low < high")
        sizes = stored(sizes.select("prefix", "n", (F.col("size") > GROUP_BYTES).alias("more")), "substring-prefixes")
        left = stored(spread_join(left, sizes, ["prefix"], "n", inner=True).select(*left.columns, "more"), "substring-windows")
        ready = left.where("not more").select("prefix", "doc_id", "text_key", "words", "spans")
        out = out.union(ready.repartition(_tasks(ready), "prefix").sortWithinPartitions("prefix").mapInArrow(of_windows, kind))
        left = left.where("more").drop("more")
    least = stored(left.groupBy("whole").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "substring-wholes")
    return out.union(spread_join(left, least, ["whole"], "n", inner=True).where("doc_id > low").select("doc_id", "text_key", "spans"))


def _tasks(found: DataFrame, task_bytes: int = 24 << 20) -> int:
    """Tasks whose groups have about this many bytes of words."""
    total = found.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    return max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // task_bytes))


def cut(docs: DataFrame, window: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed and kept (the words left, joined by one space).

    Only the first row of a text with several doc_ids is searched: a later copy loses every word, if it has a window
    at all.  A null text has no words and a null ``kept``; rows without a doc_id lose nothing and take nothing away.
    Rows that share a doc_id take nothing from each other, and what one of them loses another text doesn't: a row is
    known by its doc_id and a hash of its text.  Columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept")
    keyed = docs.withColumn("text_key", F.xxhash64("text")).withColumn("_digest", F.unhex(F.sha2("text", 256)))
    # copies: doc_id and digest alone are grouped
    copies = keyed.where("text is not null").groupBy("_digest").agg(F.min("doc_id").alias("_low"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = keyed.select("doc_id", "text_key", "_digest").join(copies, "_digest").where("doc_id > _low").select("doc_id", "text_key").distinct()
    later = stored(later, "substring-copies")
    gone = _spans_of(earlier_repeats(keyed.select("doc_id", "text_key", "text").join(later, ["doc_id", "text_key"], "left_anti"), window))
    marks = gone.select("doc_id", F.col("text_key").alias("_key"), F.col("gone").alias("_gone"), F.lit(False).alias("_copy")).union(later.select("doc_id", "text_key", F.lit(None).cast("array<struct<first:int,end:int>>"), F.lit(True)))
    return _removed(docs, marks, window, block_bytes)


def _removed(docs: DataFrame, marks: DataFrame, window: int, block_bytes: int) -> DataFrame:
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(batches):
        for block in ragged.blocks(batches, "text", block_bytes):
            data, starts, ends, rows = _words(block.column("text"))
            n = np.diff(rows)
            gone = block.column("_gone")
            flat = gone.flatten()
            doc = np.repeat(np.arange(block.num_rows), gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            edge = np.zeros(len(starts) + 1, np.int64)
            if len(flat):
                np.add.at(edge, rows[doc] + flat.field("first").to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, rows[doc] + flat.field("end").to_numpy(zero_copy_only=False), -1)
            out = np.cumsum(edge[:-1]) > 0
            copy = block.column("_copy").fill_null(False).to_numpy(zero_copy_only=False) & (n >= window)
            out |= np.repeat(copy, n)
            n_removed = ragged.row_sums(out, rows)
            # the bytes of kept words and one byte (a space) after each
            keep = ~out
            spot = ragged.ranges(starts[keep], ends[keep] - starts[keep] + 1)
            body = data[spot]
            size = np.where(keep, ends - starts + 1, 0)
            body[np.cumsum(size[keep]) - 1] = 0x20
            bounds = np.r_[0, np.cumsum(size)][rows]
            raw = body.tobytes()
            null = block.column("text").is_null().to_pylist()
            kept = [None if no else raw[a : b - 1 if b > a else b].decode() for a, b, no in zip(bounds[:-1].tolist(), bounds[1:].tolist(), null, strict=True)]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(n), pa.array(n_removed), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return docs.withColumn("_key", F.xxhash64("text")).join(marks, ["doc_id", "_key"], "left").select(*names, "_gone", "_copy").mapInArrow(remove, schema)


def digest(out: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
