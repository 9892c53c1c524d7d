"""Vectorised text kernels that run inside Spark tasks.

All functions work on the raw UTF-8 buffer of an Arrow string column, so a batch of
documents is hashed in a handful of numpy passes and no per-word Python runs.  Sums of powers are
held for ``SEGMENT`` bytes at a time; hashes and places of words follow the text given.

A word is a maximal run of characters other than space and 0x09-0x0D; A-Z compare as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 19
#: Bytes of text a task handles in one numpy pass.
PASS_BYTES = 1 << 20

_BASE = U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
#: One odd multiplier for each place of a word in a shingle (shingles of up to 64 words; longer ones repeat with a stir).
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective stir of 64 bits (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 4096)
        inverse = U(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=U)
            steps[0] = U(1)
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    column = column.cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(batch: pa.RecordBatch, text: str, limit: int = PASS_BYTES):
    """Slices of a batch with about ``limit`` bytes of text each (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True):
    """Hash, start and end of each word, and the n + 1 offsets of the documents in them."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U), none, none, np.zeros(len(offsets), dtype=np.int64)
    ink = ~_BLANK[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:n]
    stop = ink
    stop[:-1] &= ~ink[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    table = _BYTE_FOLDED if fold else _BYTE
    hashes = np.empty(len(starts), dtype=U)
    at = 0
    while at < len(starts):
        low = starts[at]
        end = max(int(np.searchsorted(ends, low + SEGMENT, "right")), at + 1)
        high = ends[end - 1]
        up, down = _power_tables(int(high - low))
        sums = np.empty(high - low + 1, dtype=U)
        sums[0] = U(0)
        np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        hashes[at:end] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        at = end
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_at(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (shorter by k - 1 than ``hashes``)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:m] * _PLACE[0]
    for j in range(1, k):
        out += (hashes[j : j + m] ^ U(j >> 6)) * _PLACE[j & 63]
    return mix(out + U(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingles of each document, end to end, and their n + 1 offsets.

    A document with 1 to k - 1 words has its whole word sequence as one shingle, one without words none.
    """
    hashes, _, _, at = words(data, offsets)
    every = shingle_at(hashes, k)
    parts, sizes = [], np.zeros(len(offsets), dtype=np.int64)
    for d in range(len(offsets) - 1):
        a, b = at[d], at[d + 1]
        if b - a >= k:
            own = np.unique(every[a : b - k + 1])
        elif b > a:
            own = shingle_at(hashes[a:b], int(b - a))
        else:
            continue
        parts.append(own)
        sizes[d + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U)), np.cumsum(sizes)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
