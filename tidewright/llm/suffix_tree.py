"""Word repeats by prefix-partitioned suffix trees.

Suffixes are partitioned by prefixes of variable length: a group that is too
large for memory gets longer prefixes until it fits. Each group becomes one
subtree, built from its sorted suffixes and the common prefixes of neighbours;
the subtree's internal nodes of enough depth are its repeats, and grouping a
node's leaves by the words before them makes the repeats maximal to the left.

Rows of ``dedup_words``: null and empty texts have no words; texts with fewer
words than a window lose none; rows with a null doc_id are left as they are
and are no source; rows that share a doc_id never remove each other; equal
windows within one document stay; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from tidewright.llm import repeats
from tidewright.llm.common import documents
from tidewright.llm.repeats import Kind
from tidewright.llm.suffixes import Chunk, neighbours, owners, true_extension

WINDOW = 50
GRAM = 16


def subtree(lcp: list[int], at: int, n: int) -> list[tuple[int, int, int]]:
    """Internal nodes (depth, first leaf, last leaf + 1) of leaves at..at+n; lcp[i] is shared by leaves i and i + 1.

    The path from the root to the newest leaf is on a stack; a shorter common
    prefix closes the nodes below it.
    """
    nodes, stack = [], [(0, at)]
    for i in range(at, at + n):
        depth = lcp[i] if i < at + n - 1 else 0
        left = i
        while stack[-1][0] > depth:
            d, left = stack.pop()
            nodes.append((d, left, i + 1))
        if stack[-1][0] < depth:
            stack.append((depth, left))
    return nodes


def sort_suffixes(suffix: np.ndarray, size: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Rows by group, then by suffix; words as ranks, eight bytes of a row compared at a time."""
    words, rank = np.unique(suffix, return_inverse=True)
    rank = rank.reshape(suffix.shape).astype(">u4") + 1
    rank[np.arange(suffix.shape[1]) >= size[:, None]] = 0  # an ended suffix sorts first
    table = np.concatenate([core.astype(">i8").view(np.uint8).reshape(len(core), 8), np.ascontiguousarray(rank.astype(">u4")).view(np.uint8).reshape(len(core), -1)], axis=1)
    pad = np.zeros((len(table), -table.shape[1] % 8), np.uint8)
    columns = np.ascontiguousarray(np.concatenate([table, pad], axis=1)).view(">u8")
    return np.lexsort(tuple(columns[:, c] for c in reversed(range(columns.shape[1]))))


def solve(chunk: Chunk) -> tuple:
    order = sort_suffixes(chunk.suffix, chunk.size, chunk.core)
    i, j = order[:-1], order[1:]
    lcp = true_extension(chunk.suffix[i], chunk.suffix[j], np.minimum(chunk.size[i], chunk.size[j]))
    same = chunk.core[i] == chunk.core[j]
    lcp = np.where(same, lcp, 0)
    cut, listed = [0, *(np.flatnonzero(~same) + 1).tolist(), len(order)], lcp.tolist()
    nodes = []
    for a, b in zip(cut, cut[1:]):
        if b - a > 1:
            nodes += subtree(listed, a, b - a)
    depth, lo, hi = np.array(sorted(nodes, key=lambda x: -x[0]) or np.zeros((0, 3)), np.int64).reshape(-1, 3).T
    n = len(order)

    def blocks(need: int) -> np.ndarray:
        """The highest node of enough depth above each leaf, by its first leaf; a leaf without one stands alone."""
        deep = depth >= need
        top = np.arange(n)
        reach = np.zeros(n + 1, np.int64)
        np.maximum.at(reach, lo[deep], hi[deep])
        far = np.maximum.accumulate(reach[:n])  # nodes nest, so a leaf below one started earlier belongs to it
        opens = (reach[:n] > 0) & (np.concatenate([[0], far[:-1]]) <= np.arange(n))
        start = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        return np.where(far > np.arange(n), start, top)

    return owners(chunk, order, neighbours(lcp), blocks)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(data, off, first, starts, ends, cover):
    import pyarrow as pa

    raw, keep, out = data.tobytes(), ~cover, []
    removed = np.concatenate([[0], np.cumsum(cover)])[first]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at = np.arange(a, b)[keep[a:b]]
        out.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())])).hexdigest())
    return [pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(out)]


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return repeats.rewrite(docs, Kind("word", window, gram, bits), solve, _finish, SCHEMA)


def op3_suffix_trees(spark, sf_dir):
    return dedup_words(documents(spark, sf_dir))
