"""What both suffix methods share: a chunk of contexts as matrices, and owners from sorted suffixes."""

from __future__ import annotations

import numpy as np

from tidewright.llm.repeats import Kind

_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    out, p = [], 1
    for _ in range(n):
        out.append(p)
        p = p * _BASE % (1 << 64)
    return np.array(out, np.uint64)


class Chunk:
    """Contexts of one range lo..hi of left reaches, as matrices.

    ``suffix``: the units from the core's start on (``size`` of them count);
    ``before``: the units before it, nearest first; ``core`` numbers the groups.
    ``codes`` holds the contexts' units in a row.
    """

    def __init__(self, kind: Kind, lo: int, hi: int, core, low, left, right, codes):
        self.kind, self.lo, self.hi = kind, lo, hi
        self.core, self.low, self.left, self.right = core, low, left, right
        length = left + kind.gram + right
        base = np.cumsum(length) - length
        flat = np.concatenate([codes, np.zeros(1, np.uint64)])
        start = left - lo
        self.size = np.minimum(kind.width, length - start)
        self.suffix = _table(flat, base + start, self.size, kind.width, 1)
        self.before = _table(flat, base + start - 1, np.minimum(hi - lo, start), hi - lo, -1)


def _table(flat, at, size, width: int, step: int) -> np.ndarray:
    """Row i: flat[at[i]], flat[at[i] + step], ... for size[i] entries, then zeros."""
    out = np.zeros((len(at), width), np.uint64)
    for j in range(width):
        live = np.flatnonzero(size > j)
        out[live, j] = flat[at[live] + step * j]
    return out


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes: column n stands for the first n units."""
    n, w = units.shape
    out = np.zeros((n, w + 1), np.uint64)
    if w:
        np.cumsum(units * _powers(w), axis=1, out=out[:, 1:])
    return out


def true_extension(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common leading units of paired rows, unit by unit, at most ``most``."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def owners(chunk: Chunk, order: np.ndarray, near: np.ndarray, blocks) -> tuple:
    """(row, lo, hi, owner): runs of l for which another row with an equal stretch has a smaller doc_id.

    ``order``: the chunk's rows by suffix; ``near``: the longer of the
    extensions shared with either neighbour; ``blocks(need)``: per place in
    that order the number of its block, whose suffixes agree in their first
    ``need`` units. Left parts are grouped by prefix hash and compared unit by
    unit.
    """
    kind, lo, hi = chunk.kind, chunk.lo, chunk.hi
    n = len(order)
    back = prefix_hashes(chunk.before[order])
    low, left, right, before = chunk.low[order], chunk.left[order], chunk.right[order], chunk.before[order]
    own = np.repeat(low[None, :], hi - lo + 1, axis=0)
    for l in range(lo, hi + 1):  # noqa: E741
        need, ext = lo + kind.gram + kind.reach - l, l - lo
        ok = np.flatnonzero((left >= l) & (right >= kind.reach - l) & (near >= need))
        if len(ok) < 2:
            continue
        block, tail = blocks(need)[ok], back[ok, ext]
        sort = np.lexsort((low[ok], tail, block))
        g, h = block[sort], tail[sort]
        new = np.ones(len(sort), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        lead = sort[np.flatnonzero(new)][np.cumsum(new) - 1]
        differs = lead != sort
        if ext and not (before[ok[sort[differs]], :ext] == before[ok[lead[differs]], :ext]).all():  # two left parts with one hash
            _, exact = np.unique(np.column_stack([block.astype(np.uint64), before[ok, :ext]]), axis=0, return_inverse=True)
            exact = exact.reshape(-1)
            least = np.full(exact.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, exact, low[ok])
            own[ext, ok] = least[exact]
            continue
        own[ext, ok[sort]] = low[ok[lead]]
    better = own < low
    begin, end = better.copy(), better.copy()
    begin[1:] &= ~better[:-1] | (own[1:] != own[:-1])
    end[:-1] &= ~better[1:] | (own[1:] != own[:-1])
    col, first = np.nonzero(begin.T)
    _, last = np.nonzero(end.T)
    return order[col], first + lo, last + lo, own[first, col]


def neighbours(shared: np.ndarray) -> np.ndarray:
    """The longer extension of each place with the one before or after it, from those of adjacent places."""
    return np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
