"""Subword ids of whole texts from the ``tokenizers`` library, which encodes each distinct piece of a batch once.

A text is cut at single spaces and line feeds where the tokenizer's own pattern always cuts too, so the ids of the
cut pieces, one after the other, are the ids of the text.  Repeated pieces, most of a corpus, are looked up.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from . import ragged

#: Entries of a worker's table of pieces; when it is full it is started anew.
CACHE = 1_000_000
#: Pieces that go to the library as one text.
JOIN = 500


_LETTER = ragged.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_PUNCTUATION = ragged.byte_class(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)


def _edge(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions before and after which a cut at white space is certain: no other white space can be there."""
    plain = (data[:n] > 0x20) & (data[:n] < 0x80) & (data[:n] != 0x7F)
    high = data[:n] >= 0x80
    before = plain | high
    if high.any():  # the last byte of a character: white space beyond ASCII has few lead bytes
        near = np.zeros(n, bool)
        lead = (data[:n] == 0xE1) | (data[:n] == 0xE2) | (data[:n] == 0xE3) | (data[:n] == 0xC2)
        for k in (1, 2):
            near[k:] |= lead[:-k]
        before &= ~(near & high)
    after = plain | (high & ~np.isin(data[:n], (0xC2, 0xE1, 0xE2, 0xE3)))
    return before, after


def _kinds(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ASCII and Latin-1 letters, and bytes of ASCII punctuation."""
    raw = data[:n]
    letter = _LETTER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    return letter, _PUNCTUATION[raw]


def _turns(data: np.ndarray, n: int, whole: list[bytes]) -> np.ndarray:
    """Positions at which a letter and punctuation meet: every pattern cuts there, but not after an apostrophe or in
    the strings ``whole``."""
    letter, mark = _kinds(data, n)
    turn = np.zeros(n, bool)
    if n > 1:
        turn[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & (data[: n - 1] != 0x27) & letter[1:])
    raw = data[:n].tobytes()
    for name in whole:
        at = raw.find(name)
        while at >= 0:
            turn[at : at + len(name) + 1] = False
            at = raw.find(name, at + 1)
    return turn


def cut_kept(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces for patterns that keep white space and join one space to the next word."""
    n = int(offsets[-1])
    head = np.zeros(n, bool)
    head[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    if n > 2:
        before, after = _edge(data, n)
        inner = np.zeros(n, bool)
        inner[1:-1] = before[:-2] & after[2:]
        inner[offsets[:-1][offsets[:-1] < n]] = False
        last = offsets[1:][offsets[1:] > 0] - 1
        inner[last] = False
        space, line = inner & (data[:n] == 0x20), inner & (data[:n] == 0x0A)
        head |= space | line | _turns(data, n, whole)
        head[1:] |= line[:-1]
    starts = np.flatnonzero(head)
    return starts, np.r_[starts[1:], n]


def cut_words(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces for patterns that drop white space."""
    n = int(offsets[-1])
    inside = ragged.NOT_SPACE[data[:n]]
    head = inside.copy()
    if n:
        head[1:] &= ~inside[:-1] | _turns(data, n, whole)[1:]
        at = offsets[:-1][offsets[1:] > offsets[:-1]]
        head[at] = inside[at]
    starts = np.flatnonzero(head)
    stop = np.append(~inside, True)
    stops = np.flatnonzero(stop)
    ends = np.minimum(np.append(starts[1:], n), stops[np.searchsorted(stops, starts)]) if len(starts) else starts
    limits = offsets[np.searchsorted(offsets, starts, "right")] if len(starts) else starts
    return starts, np.minimum(ends, limits)


class Encoder:
    """Ids of the texts of an Arrow column.  ``kept``: the pattern keeps white space; else words alone count."""

    def __init__(self, path: str, kept: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A line feed is a token of its own between two pieces; where white space is dropped, a control character is.
        self.mark, self.between = ("\n", "\n") if kept else ("\x01", " \x01 ")
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.starts, self.lengths, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has.  Many pieces go to the library as one text, between marks."""
        lengths = np.zeros(len(texts), np.int64)
        # white space at an end may go together with the mark, but for one space that a word follows
        wide = lambda t: t[-1:].isspace() or (t[:1].isspace() and (t[0] != " " or t[1:2].isspace()))
        apart = {i for i, t in enumerate(texts) if self.mark in t or "<|" in t or wide(t)}
        plain = [i for i in range(len(texts)) if i not in apart] if apart else list(range(len(texts)))
        groups = [plain[k : k + JOIN] for k in range(0, len(plain), JOIN)]
        parts: dict[int, np.ndarray] = {}
        for group, ids in zip(groups, self.encode([self.between.join([texts[i] for i in g]) + self.between for g in groups]), strict=True):
            flat = np.array(ids, np.uint32)
            at = np.flatnonzero(flat == self.mark_id)
            if len(at) == len(group):
                lengths[group] = np.diff(np.r_[-1, at]) - 1
                parts[group[0]] = flat[flat != self.mark_id]
            else:  # a mark was lost
                apart.update(group)
        odd = sorted(apart)
        for i, ids in zip(odd, self.encode([texts[i] for i in odd]), strict=True):
            lengths[i], parts[i] = len(ids), np.array(ids, np.uint32)
        ids = np.zeros(int(lengths.sum()), np.uint32)
        starts = np.cumsum(lengths) - lengths
        for group in groups:
            if group[0] not in apart:
                ids[ragged.ranges(starts[group], lengths[group])] = parts[group[0]]
        for i in odd:
            ids[starts[i] : starts[i] + lengths[i]] = parts[i]
        return ids, lengths

    def _add(self, keys: list[int], texts: list[str]) -> None:
        for k in range(0, len(texts), 50_000):
            flat, lengths = self._flat(texts[k : k + 50_000])
            at = len(self.known)
            self.known.update(zip(keys[k : k + 50_000], range(at, at + len(lengths)), strict=True))
            while at + len(lengths) > len(self.starts):
                self.starts, self.lengths = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.lengths, np.zeros_like(self.lengths)]
            while self.used + len(flat) > len(self.pool):
                self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
            self.pool[self.used : self.used + len(flat)] = flat
            self.lengths[at : at + len(lengths)] = lengths
            self.starts[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(flat)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's ids."""
        ids, ends, _, rows = self.parts(texts)
        return ids, ends[rows]

    def parts(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the offsets of each piece's ids, the last byte of each piece, and each text's first piece."""
        data, offsets = ragged.text_bytes(texts)
        begin, end = (cut_kept if self.kept else cut_words)(data, offsets, self.whole)
        rows = np.searchsorted(begin, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), begin, rows
        if len(self.known) > CACHE:
            self.clear()
        hashes = ragged.span_hash(data, begin, end)
        codes, distinct = pd.factorize(hashes)
        slots = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            at = first[new]
            self._add(distinct[new].tolist(), ragged.span_list(data, begin[at], end[at]))
            slots[new] = len(self.known) - len(new) + np.arange(len(new))
        lengths = self.lengths[slots][codes]
        ids = self.pool[ragged.ranges(self.starts[slots][codes], lengths)]
        return ids, np.r_[0, np.cumsum(lengths)], end - 1, rows


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kept: bool) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append an end id to each text's ids."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


