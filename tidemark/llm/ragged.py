"""Ragged numpy views of Arrow text columns, shared by the operators that work on batches inside tasks.

A text column becomes one byte array with row offsets; words are (start, end) spans in it.  Nothing here knows
about Spark: the functions are called on the record batches that ``mapInArrow`` hands to a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

PAD = 8
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
LONG_SPAN = 4096


def byte_class(predicate) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(predicate(b)) for b in range(256)])


#: Bytes of words split at ASCII white space (0x20 and 0x09 to 0x0D).
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def blocks(batches, column: str, limit: int):
    """Regroup record batches so that each holds about ``limit`` bytes of ``column``; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _offsets(_large(batch.column(column)))
        at, rows = 0, batch.num_rows
        while at < rows:
            end = int(np.searchsorted(offsets, offsets[at] + max(limit - size, 0), "right")) - 1
            if end <= at and held:
                yield pa.concat_batches(held)
                held, size = [], 0
                continue
            end = min(max(end, at + 1), rows)
            held.append(batch.slice(at, end - at))
            size += int(offsets[end] - offsets[at])
            at = end
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _large(array):
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_binary(array.type):
        return array.cast(pa.large_binary())
    return array if pa.types.is_large_string(array.type) else array.cast(pa.large_string())


def _offsets(array) -> np.ndarray:
    if not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, padded by PAD zero bytes, and the offsets of its rows (null: empty)."""
    array = _large(array)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_large_binary(array.type) else "")
    offsets = _offsets(array)
    raw = array.buffers()[2] if len(array) else None
    data = np.zeros(int(offsets[-1] - offsets[0]) + PAD, np.uint8)
    if raw is not None and len(data) > PAD:
        data[:-PAD] = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes in class ``inside``, cut at row limits, and each row's first run."""
    n = int(offsets[-1])
    flag = inside[data[:n]]
    first, last = flag.copy(), flag.copy()
    if n:
        first[1:] &= ~flag[:-1]
        last[:-1] &= ~flag[1:]
        filled = offsets[1:] > offsets[:-1]
        at = offsets[:-1][filled]
        first[at] = flag[at]
        at = offsets[1:][filled] - 1
        last[at] = flag[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    h = (h ^ (h >> _SHIFT)) * _M2
    h = (h ^ (h >> _SHIFT)) * _M2
    return h ^ (h >> _SHIFT)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of padded bytes, eight bytes of every span at a time."""
    words = np.ndarray((len(data) - PAD + 1,), "<u8", data.data, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = left.astype(np.uint64) * _M1
    long = np.flatnonzero(left > LONG_SPAN)
    for i in long:
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    left[long] = 0
    at = starts.astype(np.int64)
    live = slice(None)
    k = 0
    while True:
        if k == 0:
            h = (h ^ (words[at] & _MASK[np.minimum(left, 8)])) * _M2 if len(h) else h
            h ^= h >> _SHIFT
            live = np.flatnonzero(left > 8)
        else:
            if not len(live):
                break
            v = words[at[live] + 8 * k] & _MASK[np.minimum(left[live] - 8 * k, 8)]
            g = ((h[live] + _M1) ^ v) * _M2
            h[live] = g ^ (g >> _SHIFT)
            live = live[left[live] > 8 * (k + 1)]
        k += 1
    return mix(h)


def span_list(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The spans as strings."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``starts`` and have these lengths, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    ends = np.cumsum(lengths)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
