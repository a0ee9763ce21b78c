"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent units read a chunk of bytes forwards and backwards; at every byte their states give a probability
for each language, and a document's probability is the mean over the bytes of its letters.  The network is trained by
backpropagation through time (Adam, fixed seed) on a bounded sample of labelled rows; only their bytes go in.

Texts are read whole, in chunks that all move one byte at a time together.  Prediction is a map over batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import ragged
from .session import small_batches

STATE, EMBED = 16, 8
#: Bytes of a chunk in prediction and in training.
CHUNK, TRAIN_CHUNK = 128, 64
#: Chunks that are read together.
BATCH = 1024
UNKNOWN = "und"
_ASCII_LETTER = ragged.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_LETTER = ragged.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80)


def _gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid of straight lines, in place."""
    x *= np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


@dataclass
class Network:
    """Weights by name: an embedding, for each direction the gates' and the candidate's, and the output's."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def start(cls, langs: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def random(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)

        w = {"embed": random(EMBED, 256)}
        for d in "fb":
            w |= {f"gates_{d}": random(2 * STATE, EMBED + STATE), f"gates0_{d}": np.zeros((2 * STATE, 1), np.float32), f"in_{d}": random(STATE, EMBED), f"in0_{d}": np.zeros((STATE, 1), np.float32), f"state_{d}": random(STATE, STATE), f"out_{d}": random(len(langs), STATE)}
        return cls(langs, w | {"out0": np.zeros((len(langs), 1), np.float32)})

    def read(self, x: np.ndarray, live: np.ndarray | None, d: str, keep: list | None = None) -> np.ndarray:
        """One direction's part of the logits (steps, languages, chunks).  ``live``: which bytes are text."""
        w = self.w
        steps, n = x.shape
        out = np.empty((steps, len(self.langs), n), np.float32)
        joint = np.zeros((EMBED + STATE, n), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            joint[:EMBED] = np.take(w["embed"], x[t], axis=1)
            h = joint[EMBED:]
            gates = _gate(w[f"gates_{d}"] @ joint + w[f"gates0_{d}"])
            update, reset = gates[:STATE], gates[STATE:]
            gated = reset * h
            new = np.tanh(w[f"in_{d}"] @ joint[:EMBED] + w[f"state_{d}"] @ gated + w[f"in0_{d}"])
            if keep is not None:
                keep.append((t, joint.copy(), gates, gated, new))
            h += update * (new - h)
            if live is not None:
                h *= live[t]
            out[t] = w[f"out_{d}"] @ h
        return out

    def probabilities(self, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        logits = self.read(x, live, "f")
        logits += self.read(x, live, "b")
        logits += self.w["out0"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradient(self, x: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over bytes and its gradient, through time in both directions."""
        w = self.w
        tape: dict[str, list] = {"f": [], "b": []}
        logits = self.read(x, live, "f", tape["f"]) + self.read(x, live, "b", tape["b"]) + w["out0"]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        count = max(float(live.sum()), 1.0)
        at = p[:, label, np.arange(len(label))]
        loss = float(-(np.log(at + 1e-9) * live).sum() / count)
        p[:, label, np.arange(len(label))] -= 1
        p *= (live / np.float32(count))[:, None, :]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out0"] = p.sum((0, 2))[:, None]
        for d in "fb":
            back = np.zeros((STATE, x.shape[1]), np.float32)
            for t, joint, gates, gated, new in reversed(tape[d]):
                e, h = joint[:EMBED], joint[EMBED:]
                update, reset = gates[:STATE], gates[STATE:]
                after = (h + update * (new - h)) * live[t]
                g[f"out_{d}"] += p[t] @ after.T
                back += w[f"out_{d}"].T @ p[t]
                back *= live[t]
                d_new = back * update * (1 - new * new)
                d_gated = w[f"state_{d}"].T @ d_new
                slope = ((gates > 0) & (gates < 1)) * np.float32(0.25)
                d_gates = np.concatenate([back * (new - h), d_gated * h]) * slope
                g[f"in_{d}"] += d_new @ e.T
                g[f"in0_{d}"] += d_new.sum(1, keepdims=True)
                g[f"state_{d}"] += d_new @ gated.T
                g[f"gates_{d}"] += d_gates @ joint.T
                g[f"gates0_{d}"] += d_gates.sum(1, keepdims=True)
                d_joint = w[f"gates_{d}"].T @ d_gates
                d_e = d_joint[:EMBED] + w[f"in_{d}"].T @ d_new
                np.add.at(g["embed"].T, x[t], d_e.T)
                back = back * (1 - update) + d_gated * reset + d_joint[EMBED:]
        return loss, g


def trained(texts: list[bytes], labels: list[str], steps: int = 160, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """A network from labelled pieces of text; every language is drawn equally often."""
    langs = sorted(set(labels))
    net = Network.start(langs, seed)
    if not langs:
        return net
    rng = np.random.default_rng(seed)
    by = [[t for t, s in zip(texts, labels, strict=True) if s == lang] for lang in langs]
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        label = rng.integers(0, len(langs), batch)
        x = np.zeros((TRAIN_CHUNK, batch), np.uint8)
        live = np.zeros((TRAIN_CHUNK, batch), np.float32)
        for k, lang in enumerate(label.tolist()):
            text = by[lang][rng.integers(len(by[lang]))]
            at = int(rng.integers(0, max(len(text) - TRAIN_CHUNK, 0) + 1))
            piece = np.frombuffer(text[at : at + TRAIN_CHUNK], np.uint8)
            x[: len(piece), k], live[: len(piece), k] = piece, 1
        _, g = net.gradient(x, live, label)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v *= min(1.0, 1.0 / (size + 1e-9))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict_block(texts: pa.Array, net: Network) -> tuple[list[str], np.ndarray]:
    """Language and its pooled probability of each text."""
    import regex

    data, offsets = ragged.text_bytes(texts)
    size = np.diff(offsets)
    rows = len(size)
    pooled, count = np.zeros((rows, len(net.langs))), np.zeros(rows)
    n = -(-size // CHUNK)
    doc = np.repeat(np.arange(rows), n)
    start = ragged.ranges(np.zeros(rows, np.int64), n) * CHUNK + offsets[:-1][doc]
    length = np.minimum(offsets[1:][doc] - start, CHUNK)
    order = np.argsort(-length, kind="stable")
    padded = np.r_[data[: offsets[-1]], np.zeros(CHUNK, np.uint8)]
    for k in range(0, len(order), BATCH) if net.langs else ():
        own = order[k : k + BATCH]
        steps = int(length[own[0]])
        at = np.arange(steps)[:, None]
        x = padded[start[own] + at]
        live = None if length[own[-1]] == steps else (at < length[own]).astype(np.float32)
        use = _LETTER[x].astype(np.float32)
        if live is not None:
            use *= live
        p = net.probabilities(x, live)
        np.add.at(pooled, doc[own], np.einsum("tln,tn->nl", p, use))
        np.add.at(count, doc[own], use.sum(0))
    total = np.r_[0, np.cumsum(_ASCII_LETTER[data[: offsets[-1]]])]
    letters = total[offsets[1:]] - total[offsets[:-1]] > 0
    raw = data.tobytes()
    for i in np.flatnonzero(~letters & (count > 0)).tolist():
        letters[i] = regex.search(r"\p{L}", raw[offsets[i] : offsets[i + 1]].decode()) is not None
    best = pooled.argmax(1) if net.langs else np.zeros(rows, np.int64)
    score = np.where(letters & (count > 0), pooled[np.arange(rows), best] / np.maximum(count, 1), 0.0) if net.langs else np.zeros(rows)
    return [net.langs[b] if ok and net.langs else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.clip(score, 0, 1)


def held_out() -> Column:
    """Rows that are kept from training: crc32 of doc_id (as text) divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, sample_pieces: int = 12_000, piece_chars: int = 160) -> Network:
    """Train on at most ``sample_pieces`` pieces of labelled rows outside the held-out part.

    Whole texts are cut into pieces of ``piece_chars`` characters, and a hash of doc_id and the piece's number chooses among
    all of them, so long texts give more.  Rows with a null text, label or doc_id teach nothing; repeated rows count once more.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = F.ceil(F.length("text") / piece_chars).cast("int")
    total = rows.agg(F.sum(n)).first()[0] or 0
    limit = int(min(1.0, 1.2 * sample_pieces / max(total, 1)) * (1 << 30))
    chance = lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 30))
    picked = F.filter(F.sequence(F.lit(0), n - 1), lambda k: chance(k) <= limit)
    part = F.transform(picked, lambda k: F.struct(chance(k).alias("at"), F.substring(F.col("text"), k * piece_chars + 1, F.lit(piece_chars)).alias("piece"), F.col("lang").alias("lang")))
    sample = rows.where(n > 0).select(F.inline(part)).where(F.trim("piece") != "").orderBy("at", "piece", "lang").limit(sample_pieces).collect()
    pairs = sorted((r["piece"], r["lang"]) for r in sample)
    return trained([p.encode() for p, _ in pairs], [lang for _, lang in pairs])


def predicted(docs: DataFrame, net: Network, block_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (columns of these names are replaced).

    ``und`` and 0 for null texts and texts without a letter.  Without any labelled row every text is ``und``.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for block in ragged.blocks(batches, "text", block_bytes):
            langs, score = predict_block(block.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    ``und`` and 0 for null texts and texts without a letter.  A null doc_id isn't held out, and teaches nothing; repeated rows
    give repeated results; texts of any length are read whole; an empty table gives no rows.  Columns but doc_id, text and lang aren't read.
    """
    net = fitted(docs)
    return predicted(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
