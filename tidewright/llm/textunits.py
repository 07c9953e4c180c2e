"""Numpy kernels over UTF-8 buffers: words, 64-bit word codes, rolling codes and window minima.

All kernels are pure functions of the bytes, so a retried task gives the same
codes. Words are maximal runs of bytes other than space and 0x09-0x0D, which
equals ``[^\\x20\\x09-\\x0D]+`` on the decoded text because UTF-8 never uses
those bytes inside a longer character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_KEEP_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG_WORD = 512

U = np.uint64
_C1, _C2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), in place on a fresh array."""
    x = x + _STEP
    x ^= x >> U(30)
    x *= _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def give_back() -> None:
    """Return this worker's free memory to the system, which does not take it back by itself."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, column: str, limit: int = 2 << 20):
    """Split Arrow record batches into row slices of about ``limit`` text bytes.

    Yields ``(rows, data, offsets)``: ``data`` holds the slice's UTF-8 bytes
    and row i is ``data[offsets[i]:offsets[i + 1]]``; null counts as empty. A
    single longer row comes alone, whole.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        if pa.types.is_large_string(col.type) or col.null_count:
            col = col.cast(pa.large_string()).fill_null("")
        wide = pa.types.is_large_string(col.type)
        n = len(col)
        if not n:
            continue
        bufs = col.buffers()
        off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset: col.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(n, max(i + 1, j))
            yield batch.slice(i, j - i), raw[off[i]: off[j]], off[i: j + 1] - off[i]
            i = j
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (n + 1 entries)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[cut] |= word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] |= word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word's bytes, eight bytes a step."""
    size = ends - starts
    code = mix(size.astype(np.uint64))
    if not len(starts):
        return code
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, k = np.flatnonzero(size <= _LONG_WORD), 0
    while len(live):
        left = size[live] - k
        chunk = eight[starts[live] + k] & _KEEP_LOW[np.minimum(left, 8)]
        code[live] = mix(code[live] ^ mix(chunk))
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG_WORD):
        code[i] = int.from_bytes(hashlib.blake2b(data[starts[i]: ends[i]].tobytes(), digest_size=8).digest(), "little")
    return code


def rolling(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of all k consecutive entries (len - k + 1 of them), by doubling."""
    if len(code) < k:
        return np.zeros(0, np.uint64)
    have, out, done = code, None, 0
    span = 1
    while True:
        if k & span:
            if out is None:
                out, done = have, span
            else:  # the entries already covered, then `span` more
                m = min(len(out), len(have) - done)
                out = mix(out[:m] * _C1 + have[done: done + m])
                done += span
        span *= 2
        if span > k:
            return out[: len(code) - k + 1]
        half = span // 2
        have = mix(have[: len(have) - half] * _C2 + have[half:])


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over all w consecutive entries."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    return op(x[: len(x) - (w - span)], x[w - span:]) if w > span else x


def anchors(gram: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least of some w consecutive entries.

    Equal stretches pick equal positions, and every w consecutive entries
    hold a picked one.
    """
    low = sliding(np.minimum, gram, w)
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(w - 1, np.uint64)
    high = sliding(np.maximum, np.concatenate([pad, low, pad]), w)
    return np.flatnonzero(high == gram)
