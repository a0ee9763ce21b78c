"""Cost-balanced packing of documents into fixed-length sequences.

The cost of a piece of n tokens is linear plus quadratic in n (attention over itself).  A group of documents gets as
many sequences as its tokens fill.  Whole sequences are cut from long documents first; the rests then go, in
descending cost, each to the sequence of lowest cost that has room.  A rest that fits nowhere is cut to fill the
sequence with the most room, and what is left of it is dealt out next.

Groups are runs of rows inside a task, so nothing is shuffled; padding is less than a sequence for each group.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import subwords
from .ragged import blocks
from .session import small_batches

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balanced(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token of these lengths once."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    full = lengths // capacity
    pieces = []
    sequence = 0
    for doc in np.flatnonzero(full).tolist():
        for k in range(int(full[doc])):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths - full * capacity
    order = np.argsort(-rest, kind="stable")  # cost grows with length, so descending length is descending cost
    order = order[rest[order] > 0].tolist()
    spots = _Spots(capacity)
    free = {s: capacity for s in range(sequence, n)}
    cost = dict.fromkeys(free, 0.0)
    for s in free:
        spots.add(capacity, 0.0, s)

    def put(doc: int, start: int, length: int, s: int) -> None:
        pieces.append((doc, start, length, s, capacity - free[s]))
        free[s] -= length
        cost[s] += linear * length + quadratic * length * length
        if free[s]:
            spots.add(free[s], cost[s], s)

    late: list[tuple[int, int, int]] = []
    for doc in order:
        start, length = int(full[doc]) * capacity, int(rest[doc])
        s = spots.cheapest(length)
        if s is None:
            late.append((doc, start, length))
        else:
            put(doc, start, length, s)
    room = [(-f, s) for s, f in free.items() if f]
    heapq.heapify(room)
    for doc, start, length in late:
        while length:
            most, s = heapq.heappop(room)
            part = min(length, -most)
            pieces.append((doc, start, part, s, capacity - free[s]))
            free[s] -= part
            start, length = start + part, length - part
            if free[s]:
                heapq.heappush(room, (-free[s], s))
    return pieces


class _Spots:
    """Sequences by their free tokens and, among those with room enough, by cost: a tree over numbers of free tokens
    whose nodes hold the lowest (cost, sequence) below them."""

    NONE = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.size)]
        self.least = [self.NONE] * (2 * self.size)

    def _renew(self, room: int) -> None:
        at = room + self.size
        self.least[at] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while at > 1:
            at >>= 1
            best = min(self.least[2 * at], self.least[2 * at + 1])
            if self.least[at] == best:
                break
            self.least[at] = best

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        if self.heaps[room][0] == (cost, sequence):
            self._renew(room)

    def cheapest(self, length: int) -> int | None:
        """Take out the sequence of lowest cost with at least this room."""
        low, high, best = length + self.size, 2 * self.size, (self.NONE, 0)
        while low < high:
            if low & 1:
                best, low = min(best, (self.least[low], low)), low + 1
            if high & 1:
                high -= 1
                best = min(best, (self.least[high], high))
            low, high = low >> 1, high >> 1
        if best[0] == self.NONE:
            return None
        at = best[1]
        while at < self.size:
            at = 2 * at + (self.least[2 * at] != best[0])
        heapq.heappop(self.heaps[at - self.size])
        self._renew(at - self.size)
        return best[0][1]


def packed(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 4096, group_bytes: int = 16 << 20) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null text is empty and has the end id alone.  Rows with one doc_id, or none, are documents of their own.  Every
    id of a document lies in one piece; texts of any length are cut into as many sequences as they fill.
    """
    small_batches(docs.sparkSession)

    def pack(batches):
        encode = subwords.encoder(path, kept=False)
        part = TaskContext.get().partitionId()
        sequence = 0
        for block in blocks(batches, "text", group_bytes):
            ids, offsets = subwords.with_end(*encode(block.column("text")), end_id)
            ids = ids.astype("<u4")
            lengths = np.diff(offsets)
            pieces = np.array(balanced(lengths, capacity, linear, quadratic), np.int64).reshape(-1, 5)
            doc, start, length, seq, at = pieces.T
            raw = memoryview(ids.tobytes())
            first = (offsets[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length * 4).tolist(), strict=True)]
            columns = [block.column("doc_id").take(pa.array(doc)), start, length, crc, lengths[doc], (part << 32) + sequence + seq, at]
            sequence += int(seq.max(initial=-1)) + 1
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(pack, PIECE)
