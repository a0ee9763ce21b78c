"""Causal self-attention language model over subword ids, trained in numpy, with a phrase memory and word statistics.

The network has one layer: embeddings with places and masked causal attention.  Its state mixes a fixed number of
distributions over ids: one is the counts of all training texts, the others are learned.  So a token costs one
row of a table instead of a softmax over the vocabulary.  A bounded sample only gives it a start; then it is trained on every
id of all training texts: every task goes on from the same weights over all its texts, and the weights of all tasks are
averaged, by the number of ids.

Scoring reads texts in windows that overlap: a window scores the tokens after its context, so each token is scored
once, with at least ``CONTEXT`` tokens before it (fewer at the start).  Windows go through masked attention in batches.

The phrase memory counts all training texts.  A text is cut into phrases after every run of four ids whose hash says so;
the run is the phrase's context.  With c of the n phrases after a context, t of them different, a phrase has the
probability max(c - 1, 0) / n + t / n * (the network's), which sums to 1: what occurs twice is known, what occurs once is not.

The base score needs the count of every word in the training part: words are counted by hash, partial counts first.
Counts of frequent words (a bounded number) go to the tasks; all others are joined.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged, subwords
from .decontamination import LOWER
from .session import bounded_sample, small_batches, spread_join, stored

WINDOW, CONTEXT, WIDTH = 64, 8, 24
#: Distributions that are mixed; the first is the counts of the training texts.
MIXED = 64
#: Windows that go through attention together.
BATCH = 64
#: Windows that a gradient adds up at a time.
PART = 64
#: Length of a step over the training texts.
RATE = 0.004
#: Groups of queries of a window; keys behind a group's last place aren't looked at.
GROUPS = 2
#: Logits are cut here, so that their exponentials stay finite.
HIGH = np.float32(60)
#: Ids before a phrase, and the bits of their hash that must be zero (phrases have 64 ids on average).
BEFORE, PHRASE_BITS = 4, 6
_MASK = np.tri(WINDOW, dtype=np.float32)
_ONES = np.ones(MIXED, np.float32)
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Options of glibc's mallopt.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def _keep_memory() -> None:
    """From now on this worker keeps freed memory for its next arrays.  By glibc's defaults it returns them after each step, and
    pages that come anew cost a fifth of a step."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        for option, value in ((_MMAP_THRESHOLD, 1 << 25), (_TRIM_THRESHOLD, 1 << 25)):
            mallopt(option, value)


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray, group: int = 8) -> None:
    """Add rows to those of a table that ``at`` names, which may repeat: sums of ``group`` rows of one place, then sums of these, and the rest one by one."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # entries are ids, which fit: a radix sort
    at = at[order]
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    places, left = at[heads], np.diff(np.r_[heads, len(at)])
    full = left // group
    often = np.flatnonzero(full)
    if len(often):
        starts = ragged.ranges(np.zeros(len(often), np.int64), full[often]) * group + np.repeat(heads[often], full[often])
        sums = np.take(rows, order[starts[:, None] + np.arange(group)].reshape(-1), axis=0).reshape(len(starts), group, -1).sum(1)
        table[places[often]] += np.add.reduceat(sums, np.r_[0, np.cumsum(full[often])[:-1]], axis=0)
    heads, left = heads + full * group, left - full * group
    for k in range(group - 1):  # rows of one rank have distinct places
        these = np.flatnonzero(left > k)
        table[places[these]] += rows[order[heads[these] + k]]


@dataclass
class Model:
    """Weights; ``index`` maps ids to entries (the last one: any id that no training text has, ``missing`` in number)."""

    index: np.ndarray
    missing: int
    w: dict[str, np.ndarray]

    @classmethod
    def start(cls, count: np.ndarray, seed: int) -> Model:
        """A model that gives ids the probabilities of their counts."""
        rng = np.random.default_rng(seed)
        order = np.argsort(-count, kind="stable")[: int((count > 0).sum())]
        n = len(order) + 1
        index = np.full(len(count), n - 1, np.int32)
        index[order] = np.arange(n - 1)
        share = np.r_[count[order], 1].astype(np.float64)
        share = np.log(share / share.sum())[:, None]

        def random(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        s = WIDTH**-0.5
        noise = random(n, MIXED, scale=0.5)
        noise[:, 0] = 0
        w = {
            "embed": random(n, WIDTH, scale=0.5), "place": random(WINDOW, WIDTH, scale=0.1), "qkv": random(WIDTH, 3 * WIDTH, scale=s) * np.repeat(np.float32([1, 1, 0.5]), WIDTH),
            "gate": random(WIDTH, MIXED, scale=s), "gate0": np.zeros(MIXED, np.float32), "mixed": (share + noise).astype(np.float32),
        }
        return cls(index, max(len(count) - (n - 1), 1), w)

    @staticmethod
    def _shares(mixed: np.ndarray) -> np.ndarray:
        """The distributions, a column each."""
        t = mixed - mixed.max(0)
        np.exp(t, out=t)
        t /= t.sum(0)
        return t

    def _given(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """What entries and places give to states, queries (scaled), keys and values, with a one behind the values of an entry, and
        whether some logit of attention may need the cut at HIGH."""
        d, w = WIDTH, self.w
        e, p = (np.concatenate([x, x @ w["qkv"], np.full((len(x), 1), one, x.dtype)], 1) for x, one in ((w["embed"], 1), (w["place"], 0)))
        for x in (e, p):
            x[:, d : 2 * d] *= x.dtype.type(d**-0.5)
        longest = [sum(float(np.sqrt(np.einsum("ij,ij->i", y, y).max())) for y in (x[:, i * d : (i + 1) * d] for x in (e, p))) for i in (1, 2)]
        return e, p, not longest[0] * longest[1] < HIGH

    @cached_property
    def tables(self) -> tuple[tuple[np.ndarray, np.ndarray, bool], np.ndarray]:
        """Of a trained model: what entries and places give, and the distributions."""
        return self._given(), self._shares(self.w["mixed"])

    def states(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        """States of a trained model (windows * (WINDOW - since), WIDTH) from place ``since`` of windows of entries on."""
        return self.hidden(x, {"given": self.tables[0]}, since)

    def hidden(self, x: np.ndarray, tape: dict, since: int = 0) -> np.ndarray:
        """States (windows * (WINDOW - since), WIDTH) after windows of entries, each from the entries up to it, and what gradients need.

        Queries go in groups of places, each against the keys up to its last place.  ``tape`` may bring what entries and places
        give (``given``); it gets each group's bounds, exponentials and their sums.
        """
        d = WIDTH
        e, p, high = tape["given"] if "given" in tape else self._given()
        all_ = np.take(e, x, axis=0)
        all_ += p
        keys, z = np.ascontiguousarray(all_[:, :, 2 * d : 3 * d].transpose(0, 2, 1)), all_[:, since:, :d].copy()
        bounds, groups = np.linspace(since, WINDOW, GROUPS + 1).astype(int).tolist(), []
        for low, end in zip(bounds[:-1], bounds[1:], strict=True):
            a = np.matmul(all_[:, low:end, d : 2 * d], keys[:, :, :end])
            if high:
                np.clip(a, -HIGH, HIGH, out=a)
            np.exp(a, out=a)
            a[:, :, low:] *= _MASK[low:end, low:end]
            seen = np.matmul(a, all_[:, :end, 3 * d :])
            total = seen[:, :, d:].copy()
            seen = seen[:, :, :d] / total
            z[:, low - since : end - since] += seen
            groups.append((low, end, a, total, seen))
        tape.update(all=all_, groups=groups)
        return z.reshape(-1, d)

    def log_probability(self, z: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target entry after its state."""
        g = self._gates(z)
        out = np.log(np.einsum("ij,ij->i", g, np.take(self.tables[1], target, axis=0)) / (g @ _ONES))
        self._spell(out, target)
        return out

    def _gates(self, z: np.ndarray) -> np.ndarray:
        g = z @ self.w["gate"]
        g += self.w["gate0"]
        np.clip(g, -HIGH, HIGH, out=g)
        np.exp(g, out=g)
        return g

    def _spell(self, logs: np.ndarray, target: np.ndarray) -> None:
        """The last entry's probability is shared by all ids that no training text has."""
        missing = target == len(self.w["mixed"]) - 1
        if missing.any():
            logs[missing] -= np.log(self.missing)

    def gradient(self, x: np.ndarray, target: np.ndarray, part: int = PART) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (a token) and its gradient of whole windows.  They go through in parts that fit a core's cache, and are added up."""
        w, d = self.w, WIDTH
        t = self._shares(w["mixed"])
        given = self._given()
        g = {k: np.zeros_like(v) for k, v in w.items()}
        used, loss, gate = np.zeros(MIXED, t.dtype), 0.0, np.ascontiguousarray(w["gate"].T)
        by_entry, by_place = (np.zeros((len(v), 4 * d), v.dtype) for v in given[:2])
        for b in range(0, len(x), part):
            tape, own = {"given": given}, target[b : b + part].reshape(-1)
            z = self.hidden(x[b : b + part], tape)
            a = self._gates(z)
            total = a @ _ONES
            share = np.take(t, own, axis=0)
            share *= a
            p = share @ _ONES
            logs = np.log(p / total)
            self._spell(logs, own)
            loss -= float(logs.sum())
            share *= (1 / p)[:, None]  # of each distribution in the target
            a *= (1 / total)[:, None]
            a -= share
            ones = np.ones(len(z), z.dtype)
            g["gate"] += z.T @ a
            g["gate0"] += ones @ a
            used += ones @ share
            _add_rows(g["mixed"], own, share)
            grads = self._attention_gradient((a @ gate).reshape(-1, WINDOW, d), tape)
            by_place += grads.sum(0)
            _add_rows(by_entry, x[b : b + part].reshape(-1), grads.reshape(-1, 4 * d))
        for k, v in (("embed", by_entry), ("place", by_place)):  # through the projections once for an entry, not for each token
            v[:, d : 2 * d] *= v.dtype.type(d**-0.5)
            g["qkv"] += w[k].T @ v[:, d:]
            g[k] += v[:, :d] + v[:, d:] @ w["qkv"].T
        t *= used
        np.subtract(t, g["mixed"], out=g["mixed"])
        g["mixed"][:, 0] = 0  # counts stay
        for v in g.values():
            v *= v.dtype.type(1 / target.size)
        return loss / target.size, g

    @staticmethod
    def _attention_gradient(dz: np.ndarray, tape: dict) -> np.ndarray:
        """From the gradient of states, that of what entries and places gave: states, queries, keys and values."""
        d, all_ = WIDTH, tape["all"]
        values = np.ascontiguousarray(all_[:, :, 3 * d :].transpose(0, 2, 1))
        out = np.empty((len(dz), WINDOW, 4 * d), dz.dtype)
        out[:, :, :d] = dz
        for low, end, a, total, seen in reversed(tape["groups"]):
            scaled = np.empty((len(dz), end - low, d + 1), dz.dtype)
            ds = scaled[:, :, :d]
            np.divide(dz[:, low:end], total, out=ds)
            np.negative(np.einsum("nwd,nwd->nw", ds, seen), out=scaled[:, :, d])
            da = np.matmul(scaled, values[:, :, :end])
            da *= a
            np.matmul(da, all_[:, :end, 2 * d : 3 * d], out=out[:, low:end, d : 2 * d])
            for at, left, right in ((2 * d, da, all_[:, low:end, d : 2 * d]), (3 * d, a, ds)):
                if end == WINDOW:  # the last group comes first, and reaches all places
                    np.matmul(left.transpose(0, 2, 1), right, out=out[:, :, at : at + d])
                else:
                    out[:, :end, at : at + d] += np.matmul(left.transpose(0, 2, 1), right)
        return out

    def score(self, ids: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
        """log10 probability of each id of texts; ``start`` stands before the first of a text."""
        rows = len(offsets) - 1
        entries = self.index[ids]
        length = np.diff(offsets)
        stride = WINDOW - CONTEXT
        n = np.where(length > 0, 1 + -(-np.maximum(length - WINDOW, 0) // stride), 0)
        doc = np.repeat(np.arange(rows), n)
        k = ragged.ranges(np.zeros(rows, np.int64), n)
        base = np.insert(entries, offsets[:-1], self.index[start])  # a start before each text
        first = offsets[:-1][doc] + doc + k * stride
        base = np.r_[base, np.zeros(WINDOW + 1, base.dtype)]
        known = np.where(k == 0, 0, CONTEXT)
        end = length[doc] - k * stride
        out = np.zeros(len(ids))
        step = np.arange(WINDOW)
        for since in (0, CONTEXT):  # first windows of texts, and all others
            these = np.flatnonzero(known == since)
            for b in range(0, len(these), BATCH):
                part = these[b : b + BATCH]
                z = self.states(base[first[part, None] + step], since)
                at = (first[part, None] + step[since:]).reshape(-1)
                use = (step[since:] < end[part, None]).reshape(-1)
                own = at - np.repeat(doc[part], WINDOW - since)
                if not use.all():
                    z, at, own = z[use], at[use], own[use]
                out[own] = self.log_probability(z, base[at + 1])
        return out / np.log(10)


class Adam:
    """Steps of gradient descent with running moments."""

    #: Weights that go through a step together.
    PIECE = 1 << 13

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))

    def move(self, x: np.ndarray, target: np.ndarray, rate: float) -> float:
        loss, g = self.model.gradient(x, target)
        self.step += 1
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        cut, root = np.float32(0.1 * min(1.0, 1.0 / (norm + 1e-9))), np.float32((1 - 0.99**self.step) ** -0.5)
        for k, v in g.items():
            whole = [x.reshape(-1) for x in (v, self.first[k], self.second[k], self.model.w[k])]
            for b in range(0, v.size, self.PIECE):  # a piece of all goes through all sums while it is in the core's cache
                v, first, second, w = (x[b : b + self.PIECE] for x in whole)
                v *= cut  # a tenth of the gradient, and then of its square
                first *= np.float32(0.9)
                first += v
                v *= v
                second *= np.float32(0.99)
                second += v
                np.sqrt(second, out=v)
                v *= root
                v += np.float32(1e-7)
                np.divide(first, v, out=v)
                v *= np.float32(rate / (1 - 0.9**self.step))
                w -= v
        return loss


def trained(model: Model, ids: np.ndarray, offsets: np.ndarray, start: int, steps: int = 1600, batch: int = 64, rate: float = 0.04, seed: int = 11) -> Model:
    """Train a model on windows drawn anywhere in the texts."""
    flow = np.insert(ids, offsets[:-1], start).astype(np.int64)
    flow = np.r_[model.index[flow], np.zeros(max(0, WINDOW + 2 - len(flow)), np.int32)]
    if len(ids) <= WINDOW:
        return model
    rng, adam = np.random.default_rng(seed), Adam(model)
    for step in range(1, steps + 1):
        at = rng.integers(0, len(flow) - WINDOW - 1, batch)[:, None] + np.arange(WINDOW)
        adam.move(flow[at], flow[at + 1], rate * min(1.0, 1.6 * (1 - step / (steps + 1))))
    return model


def phrases(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First id, hash of the context and hash of the ids of each phrase; the first of a text has the context 0."""
    n = len(ids)
    x = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    run = np.zeros(n, np.uint64)
    for k in range(BEFORE, 0, -1):  # of the ids before each place
        run[k:] += x[: n - k] * np.uint64(2 * k + 1)
    run = ragged.mix(run)
    inside = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    head = (inside >= BEFORE) & (run >> np.uint64(64 - PHRASE_BITS) == 0)
    head |= inside == 0
    first = np.flatnonzero(head)
    context = np.where(inside[first] == 0, np.uint64(0), run[first])
    if not n:
        return first, context, context
    place = (np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))).astype(np.uint64)
    sums = np.add.reduceat(ragged.mix(x ^ ragged.mix(place + np.uint64(7))), first)
    return first, context, ragged.mix(sums)


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of doc_id (as text) leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _lowered(texts: pa.Array) -> pa.Array:
    data, offsets = ragged.text_bytes(texts)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(LOWER[data].tobytes()))


def start_sample(rows: DataFrame, counted: DataFrame, sample_rows: int = 4000, window: int = 512) -> list[bytes]:
    """Stretches of ids of at most ``sample_rows`` training rows, each from anywhere in its text, to start the network."""
    size = F.octet_length("ids")
    at = (F.pmod(F.xxhash64("row"), F.greatest((size / 2 - window), F.lit(1)).cast("long")) * 2 + 1).cast("int")
    picked = bounded_sample(rows.select(F.col("row").alias("doc_id"), F.substring("ids", at, F.lit(2 * window)).alias("ids")), counted, sample_rows)
    return sorted(bytes(r["ids"]) for r in picked.collect())


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the stored rows."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), "<u2"), minlength=size)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def passed(flows: Iterable[np.ndarray], model: Model, first: int, batch: int | None = None, rate: float = RATE) -> int:
    """Train a model in place on every id of ``flows`` (ids of whole texts, an end after each) once; returns how many.

    Windows follow each other without a gap, after the entry ``first``, so that each id is a target; the last one reaches
    back (of too few ids, it repeats them).  A step has so many windows that its passes over the tables cost little beside them.
    """
    batch = batch or max(64, model.w["mixed"].size // 1000)
    adam, held, size, done, span = Adam(model), [np.array([first], np.int32)], 1, 0, batch * WINDOW
    gone = held[0][:0]

    def step(flow: np.ndarray) -> None:
        x = np.lib.stride_tricks.sliding_window_view(flow, WINDOW + 1)[::WINDOW]
        adam.move(x[:, :-1], x[:, 1:], rate)

    for ids in flows:
        held.append(model.index[ids])
        size, done = size + len(ids), done + len(ids)
        if size > span:
            flow, at = np.concatenate(held), 0
            while len(flow) - at > span:
                step(flow[at : at + span + 1])
                at += span
            gone, held, size = flow[at - WINDOW : at], [flow[at:]], len(flow) - at
    flow = np.concatenate(held)
    whole = (len(flow) - 1) // WINDOW * WINDOW
    if whole:
        step(flow[: whole + 1])
    if len(flow) - 1 > whole:  # ids behind the last whole window
        last = np.concatenate([gone, flow])[-WINDOW - 1 :]
        step(np.r_[last, np.resize(last[1:], WINDOW + 1 - len(last))])
    return done


def averaged(rows: DataFrame, model: Model, start: int, chunks: int = 64) -> Model:
    """The mean of the weights that tasks reach from ``model`` over all ids of their rows, by the number of ids."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = list(model.w)

    def train(batches):
        _keep_memory()
        base = shared.value
        own = Model(base.index, base.missing, {k: v.copy() for k, v in base.w.items()})

        def flows():
            for batch in batches:
                data, limits = ragged.text_bytes(batch.column("ids"))
                yield np.frombuffer(data[: limits[-1]].tobytes(), "<u2")

        n = passed(flows(), own, int(base.index[start]))
        if n:
            flat = np.concatenate([own.w[k].reshape(-1) for k in names])
            parts = np.array_split(flat * np.float32(n), chunks)
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([n] * chunks, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "n", "sums"])

    def add(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch_ in batches:
            for c, n, raw in zip(batch_.column("chunk").to_pylist(), batch_.column("n").to_pylist(), batch_.column("sums"), strict=True):
                have, total = sums.get(c, (0, 0))
                sums[c] = have + n, total + np.frombuffer(raw.as_buffer(), np.float32)
        for c, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["chunk", "n", "sums"])

    kind = "chunk int, n long, sums binary"
    found = sorted(rows.select("ids").mapInArrow(train, kind).repartition(chunks, "chunk").mapInArrow(add, kind).collect())
    if not found:
        return model
    flat = np.concatenate([np.frombuffer(r["sums"], np.float32) / np.float32(r["n"]) for r in found])
    out, at = {}, 0
    for k in names:
        out[k] = flat[at : at + model.w[k].size].reshape(model.w[k].shape)
        at += model.w[k].size
    return Model(model.index, model.missing, out)


def fitted(rows: DataFrame, end_id: int, size: int) -> Model:
    """A model of the stored training rows: counts of all, a start on a bounded sample, and then a pass over every id of them all."""
    model = Model.start(id_counts(rows, size), 11)
    sample = [np.frombuffer(b, "<u2") for b in start_sample(rows, rows.select("row"))]
    offsets = np.r_[0, np.cumsum([len(x) for x in sample])].astype(np.int64)
    model = trained(model, np.concatenate([*sample, np.zeros(0, np.uint16)]).astype(np.int64), offsets, end_id)
    return averaged(rows, model, end_id)


def remembered(rows: DataFrame) -> DataFrame:
    """row and gain: what the phrase memory of the training rows adds to the network's score of a row.

    ``rows``: row, held_out and phrases (context, phrase, score).
    """
    each = rows.select("row", "held_out", F.inline("phrases"))
    pairs = stored(each.where("not held_out").groupBy("context", "phrase").agg(F.count("*").alias("c")), "lm-phrases")
    contexts = pairs.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("t")).where("n > t")
    known = spread_join(each.select("row", "context", "phrase", "score"), stored(contexts, "lm-contexts"), ["context"], "n", inner=True)
    known = spread_join(known, pairs.where("c > 1"), ["context", "phrase"], "c")
    share = F.log10(F.col("t") / F.col("n"))
    gain = F.when(F.col("c").isNull(), share).otherwise(F.log10((F.col("c") - 1) / F.col("n") + F.col("t") / F.col("n") * F.pow(F.lit(10.0), "score")) - F.col("score"))
    return known.groupBy("row").agg(F.sum(gain).alias("gain"))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a block, each word's place among them, and rows' first words."""
    data, offsets = ragged.text_bytes(texts)
    data = LOWER[data]
    starts, ends, rows = ragged.spans(data, offsets, ragged.NOT_SPACE)
    codes, distinct = pd.factorize(ragged.span_hash(data, starts, ends))
    return distinct.view(np.int64), codes, rows


def word_counts(docs: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """word (a 64-bit hash) and c: its count in the training part.  Counts of a block are added before the shuffle."""

    def count(batches):
        for block in ragged.blocks(batches, "text", block_bytes):
            distinct, codes, _ = _tokens(block.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "n"])

    return docs.where(~held_out()).select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted) and counts above the least power of two that no more than ``most`` words reach."""
    shares = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().collect()
    total, power = 0, 64
    for row in sorted(shares, key=lambda r: -r["power"]):
        total += row["count"]
        if total > most:
            break
        power = row["power"]
    found = counts.where(F.col("c") >= F.lit(2.0**power)).toPandas()
    order = np.argsort(found["word"].to_numpy())
    return found["word"].to_numpy()[order], found["c"].to_numpy()[order]


def scored(docs: DataFrame, path: str, end_id: int = 50256, size: int = 50257, frequent_words: int = 300_000, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null text is empty: its end is its only token.  Repeated rows are scored each; texts of any length are scored whole.
    Without any training row all counts are zero, and the model knows no id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if size > 1 << 16:
        raise ValueError("ids are stored in 16 bits")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(docs), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = docs.where(~held_out()).select("doc_id").count()
    train, distinct_words = sums["n"] + ends, sums["v"] + (ends > 0)
    hot_words = spark.sparkContext.broadcast(frequent(counts, frequent_words))

    def encode(batches):
        hot, hot_count = hot_words.value
        encoder = subwords.encoder(path, kept=True)
        logs = np.log10(hot_count + 1.0)
        row = TaskContext.get().partitionId() << 33
        for block in ragged.blocks(batches, "text", block_bytes):
            texts = _lowered(block.column("text"))
            ids, offsets = subwords.with_end(*encoder(texts), end_id)
            raw = ids.astype("<u2").tobytes()
            distinct, codes, rows = _tokens(texts)
            at = np.minimum(np.searchsorted(hot, distinct), max(len(hot) - 1, 0))
            known = hot[at] == distinct if len(hot) else np.zeros(len(distinct), bool)
            value = np.where(known, logs[at], 0.0) if len(hot) else np.zeros(len(distinct))
            doc = np.repeat(np.arange(block.num_rows), np.diff(rows))
            far = np.flatnonzero(~known[codes])
            pair, n = np.unique(doc[far] * np.int64(max(len(distinct), 1)) + codes[far], return_counts=True)
            pair_doc, pair_word = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
            bounds = np.searchsorted(pair_doc, np.arange(block.num_rows + 1))
            rare = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(distinct[pair_word]), pa.array(n, pa.int64())], ["word", "n"]))
            own = pa.array([raw[2 * a : 2 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(block.num_rows)), block.column("doc_id"), own, pa.array(np.diff(rows) + 1), pa.array(ragged.row_sums(known[codes], rows)), pa.array(ragged.row_sums(value[codes], rows)), rare],
                ["row", "doc_id", "ids", "n_tokens", "near_known", "near_logs", "rare"],
            )
            row += block.num_rows

    kind = "row long, doc_id long, ids binary, n_tokens long, near_known long, near_logs double, rare array<struct<word long, n long>>"
    rows = stored(docs.mapInArrow(encode, kind).withColumn("held_out", held_out()), "lm-rows")
    shared = spark.sparkContext.broadcast(fitted(rows.where("not held_out").select("row", "ids"), end_id, size))

    def score(batches):
        _keep_memory()
        model = shared.value
        for block in ragged.blocks(batches, "ids", block_bytes // 2):
            data, limits = ragged.text_bytes(block.column("ids"))
            ids, offsets = np.frombuffer(data[: limits[-1]].tobytes(), "<u2"), limits // 2
            each = model.score(ids, offsets, end_id)
            first, context, phrase = phrases(ids, offsets)
            bounds = np.searchsorted(first, offsets)
            parts = np.add.reduceat(each, first) if len(first) else each
            found = pa.StructArray.from_arrays([pa.array(context.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(parts)], ["context", "phrase", "score"])
            yield pa.RecordBatch.from_arrays([block.column("row"), block.column("held_out"), pa.array(ragged.row_sums(each, offsets)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)], ["row", "held_out", "network", "phrases"])

    read = stored(rows.select("row", "held_out", "ids").mapInArrow(score, "row long, held_out boolean, network double, phrases array<struct<context long, phrase long, score double>>"), "lm-phrases")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    far = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("far_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("far_logs"))
    end_log, norm = float(np.log10(ends + 1.0)), float(np.log10(train + distinct_words + 1.0))
    none = F.lit(0)
    whole = rows.drop("rare", "ids").join(read.select("row", "network"), "row").join(remembered(read), "row", "left").join(far, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("near_known") + F.coalesce("far_known", none) + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(train)).cast("long").alias("train_tokens"),
        (F.col("near_logs") + F.coalesce("far_logs", none) + F.lit(end_log) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("network") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
