"""Benchmark decontamination by CGK embedding and sampled steps.

Texts are read as lower-case runs of letters and digits. The embedding walks a
run of words: at step j it emits the word it stands on and moves on if a random
bit of (j, word) says so; the steps of a walk make a key, equal for equal runs.
No match is left to chance: an item of n words at e edits keeps at least
``n + 1 - q * (e + 1)`` of its runs of q words, wherever the edits are, each at
a place of its own in the text. q is the longest run up to ``RUN`` for which
that is at least one. All runs of an item are in the table, all runs of a text
are looked up, and a stretch with that many of an item's runs is verified by
the exact edit distance of the whole item to the best-fitting stretch
(bit-parallel dynamic programming). Runs with a word outside the benchmark are
passed over, as no item has them. So every match within the allowed edits is
found; see ``run_of``.

The benchmark is the query set: it is read in blocks of about ``BLOCK`` items
and ``BLOCK_CHARS`` characters at most, each held by every task, against all documents.

Rows: null and empty texts and items match nothing; repeated rows are searched
each, and give one result row per doc_id and item; a null doc_id or item_id
stays null; extra columns are ignored, or kept by ``drop_contaminated``; empty
tables give no rows. Of equally good stretches the earliest counts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import documents, prepare
from tidewright.llm.textunits import lower_ascii, mix, slices, word_codes

U = np.uint64
BLOCK = 20_000
BLOCK_CHARS = 8 << 20
RUN = 4
STEPS = 3
PERCENT = 80
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PAD = U(0xD1B54A32D192ED03)
_BITMAP = 18


def units(data: np.ndarray, off: np.ndarray):
    """(codes, first) of the lower-case runs of letters, digits and non-ASCII bytes."""
    low = lower_ascii(data)
    inside = ~_BREAK[low]
    n = len(low)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    cut = off[(off > 0) & (off < n)]
    a, b = inside.copy(), inside.copy()
    a[1:] &= ~inside[:-1]
    b[:-1] &= ~inside[1:]
    a[cut] |= inside[cut]
    b[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(a), np.flatnonzero(b) + 1
    return word_codes(low, starts, ends), np.searchsorted(starts, off)


def edits_allowed(n: int, percent: int = PERCENT) -> int:
    return n * (100 - percent) // 100


def run_of(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(q, t): any stretch within the allowed edits of an item of n words has at least t of the item's runs of q words."""
    e = edits_allowed(n, percent)
    q = max(1, min(RUN, n // (e + 1)))
    return q, max(1, n + 1 - q * (e + 1))


class Walk:
    """A random walk over runs of one length."""

    def __init__(self, run: int):
        self.run = run
        self.seed = mix(np.array([run], np.uint64))[0]

    def keys(self, code: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Keys of the runs that start at ``pos``."""
        m = mix(code ^ self.seed)
        cur, end = pos.copy(), pos + self.run
        out = np.zeros(len(pos), np.uint64)
        for j in range(STEPS * self.run if self.run > 1 else 1):
            x = np.where(cur < end, m[np.minimum(cur, len(m) - 1)], _PAD)
            out = (out ^ x) * U(0x9E3779B97F4A7C15) + U(j)
            cur += ((x >> U(j & 63)) & U(1)).astype(np.int64)
        return mix(out)


class Block:
    """Items with their tables, for matches of at least ``percent``."""

    def __init__(self, ids: list, texts: list[str], percent: int = PERCENT):
        self.percent = percent
        self.ids, self.codes = [], []
        for i, t in zip(ids, texts):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            code, _ = units(raw, np.array([0, len(raw)]))
            if len(code):
                self.ids.append(i)
                self.codes.append(code)
        self.vocabulary = np.unique(np.concatenate([*self.codes, np.zeros(0, np.uint64)]))
        self.words = np.zeros(1 << 20, bool)
        self.words[(self.vocabulary >> U(44)).astype(np.int64)] = True
        self.least = np.array([run_of(len(c), percent)[1] for c in self.codes], np.int64)
        self.tables: list[tuple] = []
        members: dict[int, list[int]] = {}
        for k, code in enumerate(self.codes):
            members.setdefault(run_of(len(code), percent)[0], []).append(k)
        for q, items in members.items():
            walk, flat = Walk(q), np.concatenate([self.codes[k] for k in items])
            base = np.cumsum([0, *(len(self.codes[k]) for k in items)])
            pos = np.concatenate([base[i] + np.arange(len(self.codes[k]) - q + 1) for i, k in enumerate(items)])
            owner = np.repeat(items, [len(self.codes[k]) - q + 1 for k in items])
            key = walk.keys(flat, pos)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)  # an item's equal runs count once at a place of the text
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[new], owner[new]
            bits = np.zeros(1 << _BITMAP, bool)
            bits[(key >> U(64 - _BITMAP)).astype(np.int64)] = True
            self.tables.append((walk, key, owner, bits))
        self.masks: dict[int, dict[int, int]] = {}

    def distance(self, k: int, text: list[int]) -> tuple[int, int]:
        """The least edit distance of item k to a stretch of ``text``, and where the first such stretch ends."""
        mask = self.masks.get(k)
        if mask is None:
            mask = {}
            for i, c in enumerate(self.codes[k].tolist()):
                mask[c] = mask.get(c, 0) | 1 << i
            self.masks[k] = mask
        n = len(self.codes[k])
        full, top = (1 << n) - 1, 1 << (n - 1)
        up, down, score, best, at = full, 0, n, n, 0
        for j, c in enumerate(text):
            eq = mask.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = (down | ~(xh | up)) & full, up & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = (ph << 1) & full, (mh << 1) & full
            up, down = (mh | ~(xv | ph)) & full, ph & xv
            if score < best:
                best, at = score, j + 1
        return best, at

    def enough_words(self, code: np.ndarray, at: np.ndarray, size: np.ndarray, item: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether stretches hold as many words of their item as a near match must; each matched word needs a place of its own."""
        out = np.zeros(len(at), bool)
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            at_once = max(1, 2_000_000 // int(size[order[a:b]].max()))
            for c in range(a, b, at_once):
                some = order[c: min(b, c + at_once)]
                steps = np.arange(int(size[some].max()))
                inside = steps < size[some][:, None]
                word = code[np.where(inside, at[some][:, None] + steps, 0)]
                out[some] = (np.isin(word, self.codes[item[some[0]]]) & inside).sum(axis=1) >= need[some]
        return out

    def search(self, code: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, item) -> (edits, end word) of the rows' best matches."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(code) or not self.codes:
            return found
        known = np.concatenate([[0], np.cumsum(self.words[(code >> U(44)).astype(np.int64)])])
        size = np.diff(first)
        words = np.array([len(c) for c in self.codes])
        edits = words * (100 - self.percent) // 100
        row_of = np.repeat(np.arange(len(size)), size)
        rows_, items_, lo_, hi_ = [], [], [], []
        for walk, keys, owner, bits in self.tables:
            q = walk.run
            pos = np.arange(max(0, len(code) - q + 1))
            pos = pos[(known[pos + q] - known[pos] == q) & (row_of[pos] == row_of[pos + q - 1])]
            if not len(pos):
                continue
            key = walk.keys(code, pos)
            hit = np.flatnonzero(bits[(key >> U(64 - _BITMAP)).astype(np.int64)])
            a, b = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
            which = np.repeat(np.arange(len(hit)), b - a)
            k = owner[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]]
            p = pos[hit[which]]
            order = np.argsort(k, kind="stable")  # places of an item in the order of the text
            k, p = k[order], p[order]
            last = np.arange(len(k)) + self.least[k] - 1
            inside = np.flatnonzero(last < len(k))
            last = last[inside]
            k, p, z, same = k[inside], p[inside], p[last], k[last] == k[inside]
            r, reach = row_of[p], words[k] + edits[k]
            near = same & (row_of[z] == r) & (z + q - p <= reach)
            r, k, p, z, reach = r[near], k[near], p[near], z[near], reach[near]
            rows_.append(r)
            items_.append(k)
            lo_.append(np.maximum(0, z + q - reach - first[r]))
            hi_.append(np.minimum(size[r], p + reach - first[r]))
        if not rows_:
            return found
        r, k, lo, hi = (np.concatenate(x) for x in (rows_, items_, lo_, hi_))
        order = np.lexsort((lo, k, r))
        r, k, lo, hi = r[order], k[order], lo[order], hi[order]
        n, most = words[k], edits[k]
        ok = self.enough_words(code, first[r] + lo, hi - lo, k, n - most)
        spans: list[list[int]] = []  # stretches that hold candidates of one row and item, joined where they overlap
        for x in zip(r[ok].tolist(), k[ok].tolist(), lo[ok].tolist(), hi[ok].tolist()):
            if spans and spans[-1][0] == x[0] and spans[-1][1] == x[1] and x[2] <= spans[-1][3]:
                spans[-1][3] = max(spans[-1][3], x[3])
            else:
                spans.append(list(x))
        for r, k, lo, hi in spans:
            least, end = self.distance(k, code[first[r] + lo: first[r] + hi].tolist())
            if least <= edits_allowed(len(self.codes[k]), self.percent) and ((r, k) not in found or least < found[r, k][0]):
                found[r, k] = (least, lo + end)
        return found


def _blocks(benchmark: DataFrame, percent: int, block: int):
    """The benchmark in blocks of about ``block`` items and BLOCK_CHARS characters at most, by hash of its id and text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("chars")).first()
    n = max(1, math.ceil(size["items"] / block), math.ceil((size["chars"] or 0) / BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        rows = sorted(items.where(part == i).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        yield Block([r["item_id"] for r in rows], [r["text"] for r in rows], percent)


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, item_words, edits, end_word."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, item_id long, item_words long, edits long, end_word long"
    out = None
    for items in _blocks(benchmark, percent, block):
        shared = spark.sparkContext.broadcast(items)  # a block's items and tables

        def run(batches, shared=shared):
            import pyarrow as pa

            for rows, data, off in slices(batches, "text"):
                code, first = units(data, off)
                got = shared.value.search(code, first)
                if got:
                    ids = rows.column(0).to_pylist()
                    table = [(ids[r], shared.value.ids[k], len(shared.value.codes[k]), e, end) for (r, k), (e, end) in sorted(got.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*table)], names=[x.split()[0] for x in schema.split(", ")])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("edits", "end_word", "item_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_words", "b.edits", "b.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows in whose text an item is found, with all their columns as they are."""
    spark = docs.sparkSession
    prepare(spark)
    for items in _blocks(benchmark, percent, block):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            import pyarrow as pa

            for rows, data, off in slices(batches, "text"):
                code, first = units(data, off)
                keep = np.ones(rows.num_rows, bool)
                keep[[r for r, _ in shared.value.search(code, first)]] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
