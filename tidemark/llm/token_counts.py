"""Token counts by rank-synchronous array merging.

A batch of texts becomes pre-tokens (a run of spaces and what follows it, up to the next space).  The distinct
pre-tokens of a batch lie in ragged numpy arrays of symbol ids, cut where two characters meet that no piece holds side by side, since no merge can
cross there.  In each round every sequence finds the lowest rank among its adjacent pairs and merges the pairs of that
rank, left to right; when no sequence has a pair in the vocabulary, what is left are the tokens.  The few long sequences
that need many rounds go on as linked arrays: the places of a rank are kept together, so that a round touches only the
pairs of the lowest rank.  A character outside the vocabulary counts as many tokens as it has bytes.

The work is a map over batches: no shuffle, memory bounded by the batch.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import ragged
from .session import small_batches

SPACE = 0x20
MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Rounds over whole arrays, after which the few sequences that still merge go on as linked arrays.
ROUNDS = 48


class PairTable:
    """Rank and product of each pair of symbols, in an open-addressing table that is probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, product: np.ndarray):
        self.bits = max(int(len(left) * 4).bit_length(), 4)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.product = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = (self._slot(keys[todo]) + step) & (size - 1)
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.rank[slot[won]], self.product[slot[won]] = rank[todo[won]], product[todo[won]]
            todo, step = todo[~won], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair isn't in the vocabulary) and product of each pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        here = self.keys[slot]
        rank = np.where(here == keys, self.rank[slot], NONE)
        product = self.product[slot]
        todo = np.flatnonzero((here != keys) & (here >= 0))
        for step in range(1, self.steps):
            if not len(todo):
                break
            slot_n = (slot[todo] + step) & ((1 << self.bits) - 1)
            here = self.keys[slot_n]
            hit = here == keys[todo]
            rank[todo[hit]], product[todo[hit]] = self.rank[slot_n[hit]], self.product[slot_n[hit]]
            todo = todo[~hit & (here >= 0)]
        return rank, product


class Vocabulary:
    """Symbols of a piece model: ids of characters, and the pairs that merge, ranked by score (equal scores tie)."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool]):
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.size = len(pieces)
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        order = np.unique(-np.asarray(scores), return_inverse=True)[1]
        rows = [(ids[p[:k]], ids[p[k:]], order[i], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.beside = np.unique(np.array([ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:], strict=False)], np.int64))
        # a character outside the vocabulary may stand in a piece too, but never merges by itself into a known pair
        self.pairs = PairTable(*(np.array([r[k] for r in rows], np.int64) for k in range(4)))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    return Vocabulary([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], plain)


def _linked(ids: np.ndarray, seq: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The sequence of each merge in ragged sequences: rank by rank, all places of the lowest rank at once.

    Sequences don't touch each other, so the lowest rank of all is the lowest of each sequence that has it.
    """
    n = len(ids)
    ids = ids.copy()
    left, right, alive = np.arange(-1, n - 1), np.append(np.arange(1, n), -1), np.ones(n, bool)
    cut = np.flatnonzero(seq[1:] != seq[:-1])
    right[cut], left[cut + 1] = -1, -1
    places: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    gone = []

    def push(at: np.ndarray) -> None:
        at = at[(at >= 0) & (right[at] >= 0)]
        rank, _ = pairs.find(ids[at], ids[right[at]])
        at, rank = at[rank != NONE], rank[rank != NONE]
        order = np.argsort(rank, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(at) else ():
            r = int(rank[part[0]])
            if r not in places:
                places[r] = []
                heapq.heappush(queue, r)
            places[r].append(at[part])

    push(np.arange(n))
    while queue:
        low = heapq.heappop(queue)
        at = np.unique(np.concatenate(places.pop(low)))
        at = at[alive[at] & (right[at] >= 0)]
        rank, product = pairs.find(ids[at], ids[right[at]])
        at, product = at[rank == low], product[rank == low]
        if not len(at):
            continue
        # of places that overlap (a a a) each second one goes, counted from the first of a run
        head = np.append(True, right[at[:-1]] != at[1:])
        origin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - origin) % 2 == 0
        every, at, product = at, at[take], product[take]
        # where a merge makes a pair of no higher rank, only the first merge of its sequence is done now
        over = right[at]
        before = left[at] >= 0
        lower = np.zeros(len(at), bool)
        lower[before] = pairs.find(ids[left[at[before]]], product[before])[0] <= low
        after = np.where(over >= 0, right[over], -1)
        ok = after >= 0
        lower[ok] |= pairs.find(product[ok], ids[after[ok]])[0] <= low
        side = np.flatnonzero(after[:-1] == at[1:])  # two merges side by side
        lower[side] |= pairs.find(product[side], product[side + 1])[0] <= low
        if lower.any():
            first = np.append(True, seq[at[1:]] != seq[at[:-1]])
            stop = np.isin(seq[at], seq[at[lower]]) & ~first
            if stop.any():
                places[low] = [every[np.isin(seq[every], seq[at[stop]])]]
                heapq.heappush(queue, low)
                at, product = at[~stop], product[~stop]
        over = right[at]
        ids[at], alive[over] = product, False
        right[at] = right[over]
        has = right[at] >= 0
        left[right[at[has]]] = at[has]
        gone.append(seq[at])
        push(np.unique(np.r_[left[at], at]))
    return np.concatenate(gone) if gone else np.zeros(0, np.int64)


def merged_counts(ids: np.ndarray, weights: np.ndarray, offsets: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Tokens of each ragged sequence of symbol ids; ``weights`` are what unmerged symbols count (bytes if unknown)."""
    count = ragged.row_sums(weights, offsets)
    seq = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for _ in range(ROUNDS):
        if len(ids) < 2:
            return count
        rank, product = pairs.find(ids[:-1], ids[1:])
        rank[seq[:-1] != seq[1:]] = NONE
        rank = np.append(rank, NONE)
        heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        best = np.minimum.reduceat(rank, heads)
        lengths = np.diff(np.r_[heads, len(ids)])
        live = best != NONE
        if not live.any():
            return count
        keep = np.repeat(live, lengths)
        ids, seq, rank, product = ids[keep], seq[keep], rank[keep], np.append(product, -1)[keep]
        best, lengths = best[live], lengths[live]
        low = np.repeat(best, lengths)
        hit = rank == low
        # pairs of a run overlap (a a a): take each second one, counted from the run's start
        run = hit.copy()
        run[1:] &= ~hit[:-1]
        at = np.flatnonzero(hit)
        origin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))[at]
        take = np.zeros(len(hit), bool)
        take[at[(at - origin) % 2 == 0]] = True
        ids, seq, low, removed = _merge(ids, seq, low, take, product, pairs)
        np.subtract.at(count, removed, 1)
    if len(ids):
        np.subtract.at(count, _linked(ids, seq, pairs), 1)
    return count


def _merge(ids, seq, low, take, product, pairs):
    """Apply the chosen merges.  Where a merge makes a pair of no higher rank, its sequence does only its first one."""
    for careful in (False, True):
        new = np.where(take, product, ids)
        gone = np.zeros(len(ids), bool)
        gone[1:] = take[:-1]
        left = ~gone
        out, at, lows, made = new[left], seq[left], low[left], take[left]
        if careful or len(out) < 2:
            break
        near = np.flatnonzero((made[:-1] | made[1:]) & (at[:-1] == at[1:]))
        rank, _ = pairs.find(out[near], out[near + 1])
        early = at[near[rank <= lows[near]]]
        # between two merges in a row, the first one's product stands beside the second one's left symbol
        row = np.flatnonzero(take[:-2] & take[2:] & (seq[:-2] == seq[2:]))
        if len(row):
            rank, _ = pairs.find(product[row], ids[row + 2])
            early = np.r_[early, seq[row[rank <= low[row]]]]
        early = np.unique(early)
        if not len(early):
            break
        first = np.zeros(len(take), bool)
        where = np.flatnonzero(take)
        head = np.r_[True, seq[where][1:] != seq[where][:-1]] if len(where) else np.zeros(0, bool)
        first[where[head]] = True
        take = np.where(np.isin(seq, early), first, take)
    return out, at, lows, seq[gone]


def count_block(texts, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text of an Arrow column."""
    data, offsets = ragged.text_bytes(texts)
    n_bytes = np.diff(offsets)
    filled = n_bytes > 0
    n_tokens = np.zeros(len(n_bytes), np.int64)
    if not filled.any():
        return n_bytes, n_tokens
    rows = np.flatnonzero(filled)
    raw = data[: offsets[-1]]
    starts = offsets[:-1][filled]
    body = np.insert(raw, starts, SPACE)  # the library puts a space before each text
    at = starts + np.arange(len(starts))
    mark = np.flatnonzero((body[:-2] == 0xE2) & (body[1:-1] == 0x96) & (body[2:] == 0x81))
    if len(mark):  # the mark of a space may stand in a text
        body[mark] = SPACE
        keep = np.ones(len(body), bool)
        keep[mark + 1] = keep[mark + 2] = False
        at = at - np.searchsorted(mark, at) * 2
        body = body[keep]
    space = body == SPACE
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[at] = True
    begin = np.flatnonzero(head)
    end = np.r_[begin[1:], len(body)]
    padded = np.r_[body, np.zeros(ragged.PAD, np.uint8)]
    codes, _ = pd.factorize(ragged.span_hash(padded, begin, end))
    first = np.full(codes.max() + 1, -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lengths = (end - begin)[first]
    own = padded[ragged.ranges(begin[first], lengths)]
    points = np.frombuffer(own.tobytes().decode("utf-8").replace(" ", MARK).encode("utf-32-le"), np.uint32)
    lead = (own & 0xC0) != 0x80
    char_at = np.flatnonzero(lead)
    char_bytes = np.diff(np.r_[char_at, len(own)])
    char_offsets = np.searchsorted(char_at, np.r_[0, np.cumsum(lengths)])
    ids = vocab.chars[points]
    weights = np.where(ids < 0, char_bytes, 1)
    ids = np.where(ids < 0, vocab.size + points.astype(np.int64), ids)  # unknown characters stay apart, and never merge
    # no merge goes over two characters that no piece holds side by side
    beside = points[:-1].astype(np.int64) << 21 | points[1:]
    known = np.minimum(np.searchsorted(vocab.beside, beside), len(vocab.beside) - 1)
    parts = np.union1d(char_offsets, np.flatnonzero(vocab.beside[known] != beside) + 1) if len(vocab.beside) and len(points) > 1 else np.unique(char_offsets)
    part_count = merged_counts(ids.astype(np.int64), weights, parts, vocab.pairs)
    count = ragged.row_sums(part_count, np.searchsorted(parts, char_offsets))
    n_tokens[rows] = ragged.row_sums(count[codes], np.r_[np.searchsorted(begin, at), len(begin)])
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text.

    A null text counts as empty: no bytes, no tokens.  Repeated rows and null ids give a row each; other columns
    are not read.  Any length of text is counted whole.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        vocab = vocabulary(model_path)
        for block in ragged.blocks(batches, "text", block_bytes):
            n_bytes, n_tokens = count_block(block.column("text"), vocab)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
