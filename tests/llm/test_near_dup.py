import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS, SCHEMA, docs_frame
from tidewright.llm import near_dup
from tidewright.llm.common import documents
from tidewright.llm.components import components


def shingles(text, k):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t, k), []).append(d)
    keys = [s for s in sets if s]
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(keys):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(keys):
        n = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    n[j] = n.get(j, 0) + 1
        for j, c in n.items():
            if 100 * c >= percent * (len(s) + len(keys[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, s in enumerate(keys):
        r = find(i)
        least[r] = min(least.get(r, 1 << 60), *sets[s])
    out = {}
    for i, s in enumerate(keys):
        for d in sets[s]:
            out[d] = (len(s), least[find(i)])
    for d in sets.get(frozenset(), []):
        out[d] = (0, d)
    return out


def check(df, rows, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    want = brute(rows, k)
    assert got == want, [(d, got.get(d), want[d]) for d in want if got.get(d) != want[d]][:5]


def test_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    out = near_dup.op9_minhash(spark, sf)
    check(out, [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()], 2)
    assert out.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_families_of_near_copies(spark):
    rng = random.Random(4)
    texts = []
    for f in range(6):
        base = [f"w{f}x{rng.randrange(500)}" for _ in range(100)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randrange(0, 14)):
                t[rng.randrange(100)] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for k in (2, 5):
        check(near_dup.near_duplicates(docs_frame(spark, texts), k), rows, k)


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, "A b", "a B", "ONE", "a b c"]
    docs = docs_frame(spark, texts)
    check(near_dup.near_duplicates(docs, 2), list(enumerate(texts)), 2)
    more = docs.unionByName(spark.createDataFrame([(3, "one", "en", None, 3, "x"), (3, "else", "en", None, 3, "x"), (None, "one", None, None, None, None), (None, None, None, None, None, None)], SCHEMA))
    out = near_dup.near_duplicates(more, 2)
    assert out.count() == len(texts) + 4 and out.where("doc_id is null and component_id is null and kept").count() == 2
    kept = near_dup.drop_near_duplicates(more)
    assert kept.columns == more.columns and kept.where("doc_id = 3").count() == 2
    assert near_dup.near_duplicates(docs.limit(0), 2).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500 + i) for i in range(1, 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_half_keys_agree_as_often_as_they_should():
    hashes = near_dup.Hashes(400, 1)
    rng = np.random.default_rng(0)
    a = near_dup.mix(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], near_dup.mix(rng.integers(0, 1 << 62, 100).astype(np.uint64))])
    keys, bits = hashes.half_keys(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((keys[:, 0] == keys[:, 1]).mean() - 900 / 1100) < 0.05
    apart = sum(int(x).bit_count() for x in (bits[:, 0] ^ bits[:, 1]).tolist())
    assert abs(apart - 128 * (1 - 900 / 1100) / 2) < 16
