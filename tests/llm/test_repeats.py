import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import ODD_TEXTS, SCHEMA, docs_frame, words
from tidewright.llm import repeats, suffix_sort, suffix_tree
from tidewright.llm.common import documents


def covered(rows, width):
    """rows: (doc_id, sequence) -> flags of units in a stretch that starts in a document with a smaller id."""
    first = {}
    for d, s in rows:
        for i in range(len(s) - width + 1):
            k = s[i: i + width]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, s in rows:
        flag = [False] * len(s)
        reach = 0
        for i in range(len(s) - width + 1):
            if first[s[i: i + width]] < d:
                for j in range(max(i, reach), i + width):
                    flag[j] = True
                reach = i + width
        out.append(flag)
    return out


def brute_bytes(rows, width):
    rows = [(d, (t or "").encode()) for d, t in rows]
    out = {}
    for (d, s), flag in zip(rows, covered(rows, width)):
        spans = sum(f and not (i and flag[i - 1]) for i, f in enumerate(flag))
        out[d] = (len(s), sum(flag), spans, hashlib.sha256(bytes(c for c, f in zip(s, flag) if not f)).hexdigest())
    return out


def brute_words(rows, width):
    rows = [(d, tuple(words(t))) for d, t in rows]
    out = {}
    for (d, s), flag in zip(rows, covered(rows, width)):
        out[d] = (len(s), sum(flag), hashlib.sha256(" ".join(w for w, f in zip(s, flag) if not f).encode()).hexdigest())
    return out


def as_bytes(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def as_words(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def same(got, want):
    assert got == want, [(d, got.get(d), want[d]) for d in want if got.get(d) != want[d]][:4]


def patched(rng, n, vocabulary, join, stock):
    """Texts made of shared stretches with changes and own words between."""
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = list(rng.choice(stock))
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s))))
            s = s[a:b]
            for _ in range(rng.randrange(0, 3)):
                if s:
                    s[rng.randrange(len(s))] = rng.choice(vocabulary)
            parts += s + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        out.append(join.join(parts))
    return out


def test_words_match_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    same(as_words(suffix_tree.op3_suffix_trees(spark, sf)), brute_words(rows, 50))


def test_bytes_match_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    same(as_bytes(suffix_sort.op10_suffix_sort(spark, sf)), brute_bytes(rows, 50))


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_patched_texts(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "HOT", group)
    monkeypatch.setattr(repeats, "SLICE", 3000)
    rng = random.Random(group)
    vocabulary = [f"w{i}" for i in range(40)]
    stock = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 300))] for _ in range(6)]
    texts = patched(rng, 80, vocabulary, " ", stock)
    texts += [texts[3], texts[5], "For " * 200, "For " * 90, "a b " * 100]
    docs = docs_frame(spark, texts)
    rows = list(enumerate(texts))
    same(as_words(suffix_tree.dedup_words(docs, 50, 16)), brute_words(rows, 50))
    same(as_words(suffix_tree.dedup_words(docs, 12, 4)), brute_words(rows, 12))
    same(as_bytes(suffix_sort.dedup_bytes(docs)), brute_bytes(rows, 50))
    chars = patched(rng, 60, list("abé "), "", [[rng.choice("abcdeé ") for _ in range(200)] for _ in range(4)])
    same(as_bytes(suffix_sort.dedup_bytes(docs_frame(spark, chars), 20, 7)), brute_bytes(list(enumerate(chars)), 20))


def test_codes_that_clash(spark, sf, monkeypatch):
    """Codes of words, anchors and contexts cut to a few bits only cost time; nothing else is removed."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).where("length(text) < 4000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want_words, want_bytes = brute_words(rows, 50), brute_bytes(rows, 50)
    for bits in (2, 10):
        same(as_words(suffix_tree.dedup_words(docs, bits=bits)), want_words)
        same(as_bytes(suffix_sort.dedup_bytes(docs, bits=bits)), want_bytes)
    monkeypatch.setattr(repeats, "HOT", 40)
    monkeypatch.setattr(repeats, "GROUP", 40)
    same(as_words(suffix_tree.dedup_words(docs, bits=6)), want_words)


def test_exact_numbers_tell_words_apart():
    rng = random.Random(2)
    for _ in range(50):
        text = " ".join(rng.choice(["a", "b", "ab", "abcdefgh", "abcdefgi", "abcdefghi", "abcdefghj", "x" * 30, "x" * 29 + "y"]) for _ in range(60)).encode()
        data = np.frombuffer(text, np.uint8)
        kind = repeats.Kind("word", 50, 16, rng.choice([1, 3, 64]))
        code, _, starts, ends = kind.units(data, np.array([0, len(data)]))
        exact = kind.exact(data, code, starts, ends)
        split = text.split()
        assert all((exact[i] == exact[j]) == (split[i] == split[j]) for i in range(len(split)) for j in range(i))


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, *ODD_TEXTS, "word " * 60]
    docs = docs_frame(spark, texts)
    rows = list(enumerate(texts))
    same(as_words(suffix_tree.dedup_words(docs)), brute_words(rows, 50))
    same(as_bytes(suffix_sort.dedup_bytes(docs)), brute_bytes(rows, 50))
    long = "word " * 3000
    more = spark.createDataFrame([(None, long, None, None, None, None), (8, long, None, None, None, None), (8, long, None, None, None, None), (9, None, None, None, None, "c")], SCHEMA)
    got = suffix_tree.dedup_words(more).collect()
    assert len(got) == 4 and all(r["n_removed"] == 0 for r in got)
    assert all(r["n_removed"] == 0 for r in suffix_sort.dedup_bytes(more).collect())
    assert suffix_tree.dedup_words(docs.limit(0)).count() == 0 and suffix_sort.dedup_bytes(docs.limit(0)).count() == 0


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 400):
        size = rng.integers(0, 12, n)
        rows = rng.integers(1, 3, (n, 12)).astype(np.uint64)
        rows[np.arange(12) >= size[:, None]] = 0
        hashes = suffix_sort.prefix_hashes(rows)
        core = rng.integers(0, max(1, n // 7), n)
        order = suffix_sort.mergesort(rows, size, hashes, core)
        want = sorted(range(n), key=lambda i: (core[i], rows[i, : size[i]].tolist(), i))
        assert order.tolist() == want


def test_subtree_nodes():
    words_ = sorted(["banana", "bandana", "band", "ban", "cab", "cabin"])
    lcp = []
    for a, b in zip(words_, words_[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        lcp.append(n)
    nodes = set(suffix_tree.subtree(lcp, 0, len(words_)))
    assert nodes == {(3, 0, 4), (4, 2, 4), (3, 4, 6)}
