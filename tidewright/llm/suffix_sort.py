"""Byte repeats by a hash-compared suffix sort.

Suffixes are compared by their longest common extension, found by binary
search over prefix polynomial hashes, so a comparison takes a logarithmic
number of hash look-ups; a bottom-up mergesort orders all suffixes of a chunk
at once, each element being ranked in its partner run by binary search. The
extensions of neighbours are then compared unit by unit, and a chunk in which
a hash lied is sorted again by its units.

Rows of ``dedup_bytes``: null and empty texts have no bytes; texts shorter
than the width lose nothing; rows with a null doc_id are left as they are and
are no source; rows that share a doc_id never remove each other; equal strings
within one document stay; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidewright.llm import repeats
from tidewright.llm.common import documents
from tidewright.llm.repeats import Kind
from tidewright.llm.suffixes import Chunk, neighbours, owners, prefix_hashes, true_extension

WIDTH = 50
GRAM = 24


def common_extension(hashes: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefixes of suffixes i and j, by binary search over their prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), np.minimum(size[i], size[j])
    for _ in range(int(hashes.shape[1]).bit_length()):
        mid = (lo + hi + 1) // 2
        same = hashes[i, mid] == hashes[j, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(lo, mid - 1))
    return lo


def less(suffix, size, hashes, i, j) -> np.ndarray:
    """Whether suffix i sorts before suffix j; a shorter one sorts before those it begins."""
    n = common_extension(hashes, size, i, j)
    w = suffix.shape[1] - 1
    a, b = suffix[i, np.minimum(n, w)], suffix[j, np.minimum(n, w)]
    end_i, end_j = n >= size[i], n >= size[j]
    return np.where(end_i | end_j, end_i & ~end_j, a < b)


def merge_blocks(perm: np.ndarray, count: np.ndarray, block: int, suffix, size, hashes) -> np.ndarray:
    """Bottom-up mergesort inside each block of ``block`` places, of which the first ``count`` hold rows.

    At each width, an element's place in the merged run is its place in its own
    run plus its rank in the partner run, by binary search, for all at once;
    equal suffixes keep their order.
    """
    at = np.flatnonzero(np.arange(len(perm)) % block < np.repeat(count, block))
    group, place, width = at // block, at % block, 1
    while width < block:
        run = place // width
        mate = group * block + (run ^ 1) * width
        lo, hi = mate.copy(), mate + np.clip(count[group] - (run ^ 1) * width, 0, width)
        late = run & 1 == 1
        for _ in range(width.bit_length()):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            mine, other, second = perm[at[live]], perm[mid], late[live]
            before = less(suffix, size, hashes, np.where(second, mine, other), np.where(second, other, mine))
            below = np.where(second, ~before, before)
            lo[live], hi[live] = np.where(below, mid + 1, lo[live]), np.where(below, hi[live], mid)
        target = group * block + (run // 2) * 2 * width + (place - run * width) + (lo - mate)
        out = perm.copy()
        out[target] = perm[at]
        perm = out
        width *= 2
    return perm


def mergesort(suffix: np.ndarray, size: np.ndarray, hashes: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The rows by group (``core``), each group in the order of its suffixes; groups of like size are sorted together."""
    order = np.argsort(core, kind="stable")
    c = core[order]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(c)))
    level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    for m in np.unique(level[level > 0]).tolist():
        some = np.flatnonzero(level == m)
        block, n = 1 << m, count[some]
        inside = np.arange(block) < n[:, None]
        where = (start[some][:, None] + np.arange(block))[inside]
        perm = np.zeros(len(some) * block, np.int64)
        perm[inside.reshape(-1)] = order[where]
        order[where] = merge_blocks(perm, n, block, suffix, size, hashes)[inside.reshape(-1)]
    return order


def solve(chunk: Chunk) -> tuple:
    hashes = prefix_hashes(chunk.suffix)
    order = mergesort(chunk.suffix, chunk.size, hashes, chunk.core)
    i, j = order[:-1], order[1:]
    shared = common_extension(hashes, chunk.size, i, j)
    true = true_extension(chunk.suffix[i], chunk.suffix[j], np.minimum(chunk.size[i], chunk.size[j]))
    if (shared != true).any():  # a hash lied: sort by the units themselves
        order = np.lexsort((chunk.size, *(chunk.suffix[:, c] for c in reversed(range(chunk.suffix.shape[1]))), chunk.core))
        i, j = order[:-1], order[1:]
        true = true_extension(chunk.suffix[i], chunk.suffix[j], np.minimum(chunk.size[i], chunk.size[j]))
    true = np.where(chunk.core[i] == chunk.core[j], true, 0)

    def blocks(need: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(true < need)])

    return owners(chunk, order, neighbours(true), blocks)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(data, off, first, starts, ends, cover):
    import pyarrow as pa

    keep = ~cover
    kept = data[keep].tobytes()
    upto = np.concatenate([[0], np.cumsum(keep)])[off]
    begin = cover.copy()
    begin[1:] &= ~cover[:-1]
    inner = off[(off > 0) & (off < len(data))]
    begin[inner] |= cover[inner]
    runs = np.concatenate([[0], np.cumsum(begin)])[off]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
    size = np.diff(off)
    return [pa.array(size), pa.array(size - np.diff(upto)), pa.array(np.diff(runs)), pa.array(digests)]


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats.rewrite(docs, Kind("byte", width, gram, bits), solve, _finish, SCHEMA)


def op10_suffix_sort(spark, sf_dir):
    return dedup_bytes(documents(spark, sf_dir))
