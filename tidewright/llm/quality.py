"""Quality rules: counted rules, then a calibrated hashed n-gram logistic regression.

Features of a text are the shares of its hashed words and word pairs and of
its hashed character trigrams, so the model's score is a mean of gathered weights
and needs no per-document vocabulary. The model is fitted on at most
``SAMPLE`` labelled rows (a documented bound; half of them of either class, by
hash order of doc_id), calibrated by Platt's method on a held-out third with
the class shares of all labels, and then scores every whole text in Arrow
batches. A text is kept if its calibrated probability of good quality is at
least ``KEEP``.

Rows: null and empty texts have no words and fail the base rules; repeated
rows are scored each (of more than ``SAMPLE`` labelled rows, because doc_ids
repeat, the first in hash order of doc_id and text train); a null doc_id is
scored too and stays null; labels that
are null, contradict each other (the lower one counts) or have no document are
no trouble; without labels of both classes every text that passes the base
rules is kept; extra columns are ignored, or passed through by ``keep_good``;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import documents, prepare
from tidewright.llm.textunits import mix, rolling, slices, word_codes, words

SAMPLE = 3000
KEEP = 0.5
BITS = 18
_HALF = 1 << (BITS - 1)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACES = b" \t\n\v\f\r"


def word_buckets(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of word pairs, in the first half of the weights."""
    shift = np.uint64(64 - BITS + 1)
    return (mix(code) >> shift).astype(np.int64), (mix(rolling(code, 2)) >> shift).astype(np.int64)


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and each row's first one (n + 1 entries)."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4"), lead[off]


def char_buckets(points: np.ndarray) -> np.ndarray:
    """Buckets of character trigrams, in the second half of the weights."""
    if len(points) < 3:
        return np.zeros(0, np.int64)
    wide = points.astype(np.uint64)
    gram = wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42)
    return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS + 1)).astype(np.int64) + _HALF


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi] for each pair; a pair with hi <= lo sums to 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    hi = np.maximum(lo, hi)
    return total[np.minimum(hi, len(values))] - total[np.minimum(lo, len(values))]


def base_counts(data: np.ndarray, off: np.ndarray, starts, ends, first, code) -> dict[str, np.ndarray]:
    """The counted rules of each row."""
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    space = np.isin(data, np.frombuffer(_SPACES, np.uint8))
    out = {"n_words": n_words, "word_chars": _sums(lead & ~space, off[:-1], off[1:]), "n_symbols": _sums(_SYMBOL[data], off[:-1], off[1:])}
    dup = np.zeros(len(n_words), np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if raw.find(b"\n", a, b) >= 0:
            lines = [x for x in raw[a:b].split(b"\n") if x.strip(_SPACES)]
            dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    gram = rolling(code, 3)
    row = np.repeat(np.arange(len(n_words)), n_words)
    inside = row[:len(gram)] == row[2:] if len(gram) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = mix(gram[at] ^ mix(row[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(code), bool)
    hit = at[twice]
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = _sums(covered, first[:-1], first[1:])
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


@dataclass
class Model:
    """Weights by bucket, intercept and Platt's two numbers."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, data, off, first, code) -> np.ndarray:
        """Uncalibrated scores of the rows: the mean weight of words and pairs, plus that of trigrams."""
        n = np.diff(first)
        one, two = word_buckets(code)
        score = _sums(self.weights[one], first[:-1], first[1:])
        score = score + (_sums(self.weights[two], first[:-1], first[1:] - 1) if len(two) else 0)
        score = score / np.maximum(1, 2 * n - 1)
        points, at = characters(data, off)
        grams = _sums(self.weights[char_buckets(points)], at[:-1], at[1:] - 2) / np.maximum(1, np.diff(at) - 2)
        return score + grams + self.bias

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -50, 50)))


def features(batches, columns: list[str]):
    """Rows' other columns with their nonzero features: index (u4) and value (f4) bytes."""
    for rows, data, off in slices(batches, "text"):
        starts, ends, first = words(data, off)
        code = word_codes(data, starts, ends)
        points, chars = characters(data, off)
        others = [rows.column(rows.schema.get_field_index(c)).to_pylist() for c in columns]
        for i in range(len(off) - 1):
            one, two = word_buckets(code[first[i]: first[i + 1]])
            w = np.bincount(np.concatenate([one, two]))
            at = np.flatnonzero(w)
            t = np.bincount(char_buckets(points[chars[i]: chars[i + 1]]))
            bt = np.flatnonzero(t)
            values = np.concatenate([w[at] / max(1, len(one) + len(two)), t[bt] / max(1, chars[i + 1] - chars[i] - 2)])
            yield [c[i] for c in others], np.concatenate([at, bt]).astype("<u4"), values.astype("<f4")


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, steps: int = 300, ridge: float = 1e-6) -> Model:
    """Logistic regression by Adam on whole batches, then Platt's calibration.

    ``rows``: (label, feature indexes, values); ``share``: the share of good
    rows among all labels, to which the calibration is weighted.
    """
    rows = sorted(rows, key=lambda r: (len(r[1]), r[0], r[1].tobytes()))  # a fixed order, whatever order they came in
    label = np.array([r[0] for r in rows], np.float64)
    held = np.arange(len(rows)) % 3 == 2

    def packed(which):
        at = np.flatnonzero(which)
        n = [len(rows[i][1]) for i in at]
        return np.concatenate([rows[i][1] for i in at] or [np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([rows[i][2] for i in at] or [np.zeros(0)]).astype(np.float64), np.repeat(np.arange(len(at)), n), label[at]

    index, value, row, y = packed(~held)
    size = 1 << BITS
    used, index = np.unique(index, return_inverse=True)
    w, bias, m, v, mb, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[index], len(y)) + bias
        d = (1 / (1 + np.exp(-z)) - y) / max(1, len(y))
        g = np.bincount(index, value * d[row], len(used)) + ridge * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.3 * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= 0.3 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    weights = np.zeros(size)
    weights[used] = w
    model = Model(weights, float(bias))
    index, value, row, y = packed(held)
    if len(set(y.tolist())) < 2:
        return model
    z = np.bincount(row, value * weights[index], len(y)) + bias
    scale = max(1e-9, float(np.abs(z).mean()))
    weight = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(60):  # Newton's steps on the two numbers
        u = z / scale
        p = 1 / (1 + np.exp(-np.clip(slope * u + shift, -40, 40)))
        e, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(e * u).sum() + 1e-3 * slope, e.sum()])
        hess = np.array([[(h * u * u).sum() + 1e-3, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - step[0], shift - step[1]
    return Model(weights, float(bias), float(slope / scale), float(shift))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled rows, or None without both classes."""
    prepare(docs.sparkSession)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    share = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r["label"] in (0, 1)}
    if len(share) < 2:
        return None
    pick = None
    for k in (0, 1):
        some = labels.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        pick = some if pick is None else pick.unionByName(some)

    def found(batches):
        import pyarrow as pa

        for (k,), index, value in features(batches, ["label"]):
            yield pa.RecordBatch.from_pydict({"label": pa.array([k], pa.int32()), "index": [index.tobytes()], "value": [value.tobytes()]})

    chosen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")  # at most `sample` rows
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(sample)  # repeated doc_ids may be more; the same ones in every run
    rows = chosen.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(found, "label int, index binary, value binary").collect()
    got = [(r["label"], np.frombuffer(r["index"], "<u4"), np.frombuffer(r["value"], "<f4")) for r in rows]
    return fit(got, share[1] / (share[0] + share[1])) if len({r[0] for r in got}) == 2 else None


def judged(rows_data_off, model: Model | None, keep: float):
    """(rows, counts, failed, probability, kept) of slices."""
    for rows, data, off in rows_data_off:
        starts, ends, first = words(data, off)
        code = word_codes(data, starts, ends)
        counts = base_counts(data, off, starts, ends, first, code)
        failed = base_failed(counts)
        p = np.ones(len(failed)) if model is None else model.probability(model.raw(data, off, first, code))
        yield rows, counts, failed, p, ~failed & (p >= keep)


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, quality (the calibrated probability)."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for rows, counts, failed, p, kept in judged(slices(batches, "text"), model, keep):
            arrays = [rows.column(0), *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS), pa.array(failed), pa.array(kept), pa.array(p)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_COUNTS, "base_failed", "kept", "quality"])

    longs = ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{longs}, base_failed boolean, kept boolean, quality double")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def keep_good(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns as they are."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for rows, _, _, _, kept in judged(slices(batches, "text"), model, keep):
            yield rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
