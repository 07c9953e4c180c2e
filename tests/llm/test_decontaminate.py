import random
import re

import numpy as np
import pytest

from tests.llm.helpers import ODD_TEXTS, SCHEMA, docs_frame
from tidewright.llm import decontaminate as dc
from tidewright.llm.common import documents


def words(t):
    return [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())]


def best_edits(item, text):
    """Least edit distance of the item to any stretch of the text, by plain dynamic programming."""
    col = list(range(len(item) + 1))
    best = col[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(col[i] + (x != w), col[i + 1] + 1, new[i] + 1))
        col = new
        best = min(best, col[-1])
    return best


def test_contains_every_exact_passage_and_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.op5_decontaminate(spark, sf).collect()}
    want = {}
    tokens = {i: words(t) for i, t in items}
    for d, t in docs:
        w = words(t)
        have = set(w)
        for i, it in tokens.items():
            if sum(x in have for x in it) >= 0.8 * len(it):
                e = best_edits(it, w)
                if e <= len(it) // 5:
                    want[d, i] = e
    assert got == want


def test_recall_of_edited_passages(spark):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))) for _ in range(60)]
    rows, want = [], []
    for d in range(600):
        k = rng.randrange(60)
        w = items[k].split()
        for _ in range(rng.randrange(0, len(w) // 5 + 1)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at: at + 1] = [[rng.choice(vocabulary)], [], [w[at], rng.choice(vocabulary)]][kind]
        around = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(around) + 1)
        text = around[:at] + w + around[at:]
        rows.append((d, " ".join(text)))
        if best_edits(items[k].split(), text) <= len(items[k].split()) // 5:
            want.append((d, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.contamination(docs, bench).collect()}
    for (d, k), e in got.items():
        assert e == best_edits(items[k].split(), rows[d][1].split())
    found = sum(x in got for x in want)
    assert found / len(want) >= 0.95, found / len(want)
    few = {(r["doc_id"], r["item_id"]) for r in dc.contamination(docs, bench, block=20).collect()}
    assert few == set(got)


def test_odd_rows(spark):
    docs = docs_frame(spark, [*ODD_TEXTS, "x, ONE! y", "the quick brown fox jumps over it"]).unionByName(spark.createDataFrame([(3, "one", "en", None, 3, "x"), (None, "one", None, None, None, None)], SCHEMA))
    bench = spark.createDataFrame([(0, "one", "c"), (1, None, "c"), (2, "", "c"), (3, "Quick brown; fox jumps over", "c"), (None, "two words", "c"), (3, "zzz", "c")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contamination(docs, bench).collect()}
    assert got == {(3, 0), (9, 0), (None, 0), (10, 3), (4, None)}
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 5, 6, 7, 8]
    assert dc.contamination(docs.limit(0), bench).count() == 0 and dc.contamination(docs, bench.limit(0)).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        text = [rng.choice("abc") for _ in range(rng.randrange(0, 20))]
        block = dc.Block([0], [" ".join(item)])
        codes = dict(zip(item, block.codes[0].tolist()))
        assert block.distance(0, [codes.get(c, 1) for c in text])[0] == best_edits(item, text)


def found_pairs(items, texts):
    """(text, item) pairs that the search finds, with their edits."""
    raw = [t.encode() for t in texts]
    code, first = dc.units(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return {x: e for x, (e, _) in dc.Block(list(range(len(items))), items).search(code, first).items()}


@pytest.mark.parametrize("n", [5, 6, 8, 12, 15, 20, 57, 100, 160, 240, 400])
def test_every_passage_with_the_most_edits_is_found(n):
    rng = random.Random(n)
    items = [[f"i{t}x{j}" for j in range(n)] for t in range(40)]
    texts = []
    for t, item in enumerate(items):
        w = list(item)
        for at in rng.sample(range(n), n // 5):
            w[at] = f"o{at}"
        texts.append(" ".join([*(f"b{j}" for j in range(rng.randrange(30))), *w, "end"]))
    got = found_pairs([" ".join(x) for x in items], texts)
    assert got == {(t, t): n // 5 for t in range(40)}


def test_search_equals_brute_force():
    rng = random.Random(5)
    items = [[rng.choice("abcdefgh") for _ in range(n)] for n in range(1, 41)]
    texts = []
    for t in range(120):
        w = list(items[t % 40])
        for _ in range(rng.randrange(len(w) // 5 + 2)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at: at + 1] = [[rng.choice("abcxyz")], [], [rng.choice("abcxyz"), *w[at: at + 1]]][kind]
        texts.append([rng.choice("abcx") for _ in range(rng.randrange(9))] + w + [rng.choice("abcx") for _ in range(rng.randrange(9))])
    want = {(t, k): e for t, x in enumerate(texts) for k, i in enumerate(items) if (e := best_edits(i, x)) <= len(i) // 5}
    assert found_pairs([" ".join(i) for i in items], [" ".join(x) + "\n" for x in texts]) == want


@pytest.mark.parametrize("n", [12, 20, 57, 100, 400])
def test_edits_close_together_by_words_outside_the_benchmark(n):
    rng = random.Random(n)
    items = [[f"i{t}x{j}" for j in range(n)] for t in range(60)]
    texts, e = [], n // 5
    for t, item in enumerate(items):
        w, near = list(item), min(n, e + e // 2 + 1)
        start = t % 3 * (n - near) // 2  # front, middle and end
        for at in rng.sample(range(start, start + near), e):
            w[at] = f"o{at}"
        texts.append(" ".join([*(f"b{j}" for j in range(rng.randrange(30))), *w, "end"]))
    assert found_pairs([" ".join(x) for x in items], texts) == {(t, t): e for t in range(60)}
