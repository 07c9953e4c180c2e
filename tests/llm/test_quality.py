from collections import Counter

import numpy as np

from tests.llm.helpers import ODD_TEXTS, SCHEMA, docs_frame, words
from tidewright.llm import quality
from tidewright.llm.common import documents


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i: i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def check(out, rows):
    texts = {d: t for d, t in rows}
    assert len(out) == len(rows)
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_counts_match_brute_force(spark, sf):
    docs = documents(spark, sf)
    check(quality.op4_quality(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, "a b c a b c\na b c\n\n \na b c", "a\tb\x1cc d e"]
    docs = docs_frame(spark, texts).unionByName(spark.createDataFrame([(3, "one", "en", None, 3, "x"), (None, None, None, None, None, None)], SCHEMA))
    check(quality.score(docs, None).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert quality.score(docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (99, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None or True
    kept = quality.keep_good(docs.withColumn("extra", docs.doc_id), None)
    assert kept.columns == [*docs.columns, "extra"]


def test_character_trigrams():
    texts = ["", "a", "ab", "abc", "é日\U0001f600b", "xyéz"]
    raw = [t.encode() for t in texts]
    points, at = quality.characters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [[chr(c) for c in points[a:b]] for a, b in zip(at, at[1:])] == [list(t) for t in texts]
    assert quality.char_buckets(points[at[3]: at[4]]).tolist() == quality.char_buckets(np.array([97, 98, 99], np.uint32)).tolist()
    assert len({int(quality.char_buckets(np.array([ord(c) for c in t], np.uint32))[0]) for t in ("abc", "cba", "é日b", "b日é")}) == 4


def test_training_is_repeatable_when_doc_ids_repeat(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    many = docs.unionByName(docs.withColumn("text", docs.lang)).unionByName(docs)
    one, two = (quality.train(d, labels, sample=60) for d in (many, many.repartition(7)))
    assert (one.weights == two.weights).all() and (one.bias, one.slope, one.shift) == (two.bias, two.slope, two.shift)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs.where("doc_id % 2 = 1"), model).withColumnRenamed("quality", "p").join(labels, "doc_id").where("not base_failed").collect()
    y, k, p = (np.array([r[c] for r in rows]) for c in ("quality", "kept", "p"))
    assert k[y == 1].mean() > 0.98
    assert k[y == 0].mean() < 0.1
    assert abs(p.mean() - y.mean()) < 0.05  # calibrated
