"""Texts of several megabytes, longer than any slice, beside short ones."""

import random

import pytest

from tests.llm import test_near_dup, test_repeats
from tests.llm.test_tokens import check_packing, ids_of
from tidewright.llm import decontaminate, near_dup, packing, pii, quality, suffix_sort, suffix_tree, token_files
from tidewright.llm.common import new_path
from tidewright.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(700_000)]
    long = " ".join(words)
    assert len(long) > 5 << 20
    passage = " ".join(words[400_000:400_080])
    return ["alpha beta", passage + " and more of its own", long, long.replace(words[300_000], "other", 1) + " password: correcthorsebattery works", passage]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(2)


def test_near_duplicates(docs, texts):
    test_near_dup.check(near_dup.near_duplicates(docs, 5), list(enumerate(texts)), 5)


def test_word_repeats(docs, texts):
    got = test_repeats.as_words(suffix_tree.dedup_words(docs))
    test_repeats.same(got, test_repeats.brute_words(list(enumerate(texts)), 50))


def test_byte_repeats(docs, texts):
    got = suffix_sort.dedup_bytes(docs).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in got}
    size = {r["doc_id"]: r["n_bytes"] for r in got}
    assert size == {d: len(t.encode()) for d, t in enumerate(texts)}
    assert removed[0] == removed[1] == 0 and removed[3] > 0.999 * (size[2] - 200) and removed[4] == size[4]


def test_counts_spans_and_passages(spark, docs, texts):
    found = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    at = texts[3].index("correcthorsebattery")
    assert f"secret:{at}:{at + 19}" in found[3].split(",")
    assert {r["doc_id"]: r["n_words"] for r in quality.score(docs, None).collect()} == {d: len(t.split()) for d, t in enumerate(texts)}
    bench = spark.createDataFrame([(7, texts[4])], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.contamination(docs, bench).collect()) == [1, 2, 3, 4]


def test_tokens(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    check_packing(packing.pack(docs).collect(), list(enumerate(texts)), library)
    folder = new_path(spark, "long")
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(token_files.write_token_files(docs, folder), folder).collect()}
    assert got == {d: len(ids_of(library, t, 2)) for d, t in enumerate(texts)}
