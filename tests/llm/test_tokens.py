import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, SCHEMA, docs_frame
from tidewright.llm import packing, token_files
from tidewright.llm.common import documents, new_path
from tidewright.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def check_packing(out, texts, library, window=packing.WINDOW):
    """texts: (doc_id, text) rows; every id in one piece, sequences gapless, next to no padding."""
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(ids_of(library, t, 1))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for d, copies in want.items():
        if len(copies) == 1:
            at = 0
            for r in sorted(got[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(copies[0])
                assert r["ids_crc32"] == zlib.crc32(copies[0][at: at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(copies[0])
        assert sum(r["length"] for r in got[d]) == sum(map(len, copies))
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding at all


def test_packing_matches_brute_force(spark, sf, library):
    docs = documents(spark, sf)
    check_packing(packing.op2_packing(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)


def test_packing_odd_rows(spark, library):
    docs = docs_frame(spark, ODD_TEXTS).unionByName(spark.createDataFrame([(3, "one", "en", None, 3, "x"), (None, "null id", None, None, None, None)], SCHEMA))
    out = packing.pack(docs, window=64, unit=16).collect()
    check_packing(out, [(r["doc_id"], r["text"]) for r in docs.collect()], library, 64)
    assert packing.pack(docs.limit(0)).count() == 0


def round_robin(lengths, weights, per_window):
    """Plain deficit round-robin in exact arithmetic: the order in which (source, unit) are sent."""
    total, deficit, at, out = sum(weights.values()), dict.fromkeys(lengths, Fraction(0)), dict.fromkeys(lengths, 0), []
    while any(at[s] < lengths[s] for s in lengths):
        for s in sorted(lengths):
            deficit[s] += Fraction(weights[s]) * per_window / total
            while deficit[s] >= 1:
                deficit[s] -= 1
                if at[s] < lengths[s]:
                    out.append((s, at[s]))
                    at[s] += 1
    return out


@pytest.mark.parametrize("mixture", [None, {"a": 0.5, "b": 0.25, "c": 0.25}, {"c": 0.5}])
def test_packing_is_a_round_robin_over_partitions(spark, library, mixture):
    rng = random.Random(3)
    rows = [(i, "alpha beta gamma delta " * rng.randrange(1, 40), rng.choice("aaabbc")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = packing.pack(docs, window=256, unit=32, mixture=mixture).collect()
    check_packing(out, [(d, t) for d, t, _ in rows], library, 256)
    tokens = {s: sum(len(ids_of(library, t, 1)) for _, t, x in rows if x == s) for s in "abc"}
    units = {s: n // 32 for s, n in tokens.items()}
    weights = units
    if mixture:
        rest = sum(units[s] for s in units if s not in mixture)
        weights = {s: Fraction(mixture[s]) if s in mixture else Fraction(units[s], rest) * (1 - Fraction(sum(mixture.values()))) for s in units}
    order = [s for s, _ in round_robin(units, weights, 8)]
    got = [None] * sum(tokens.values())
    for r in out:
        a = r["sequence_id"] * 256 + r["offset"]
        if a + r["length"] <= 32 * len(order):
            got[a: a + r["length"]] = [r["source"]] * r["length"]
    assert [got[32 * i] for i in range(len(order))] == order
    assert all(got[32 * i: 32 * i + 32] == [order[i]] * 32 for i in range(len(order)))


def test_packing_sends_a_source_of_proportion_0_last(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 30, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string").repartition(3)
    out = packing.pack(docs, window=256, unit=32, mixture={"a": 0.0, "b": 1.0}).collect()
    full = [r for r in out if r["sequence_id"] < max(x["sequence_id"] for x in out) - 8]
    last_b = max(r["sequence_id"] for r in full if r["source"] == "b")
    assert all(r["sequence_id"] >= last_b for r in full if r["source"] == "a")
    with pytest.raises(ValueError):
        packing.pack(docs, mixture={"a": 0.8, "b": 0.8})


def test_token_files_match_brute_force(spark, sf, library):
    got = sorted(token_files.op7_token_files(spark, sf).collect(), key=lambda r: r["doc_id"])
    at = 0
    rows = sorted(documents(spark, sf).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        ids = ids_of(library, r["text"], 2)
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_odd_rows(spark, library):
    docs = docs_frame(spark, ODD_TEXTS).unionByName(spark.createDataFrame([(3, "one", "en", None, 3, "x"), (None, "null id", None, None, None, None)], SCHEMA))
    folder = new_path(spark, "odd")
    got = token_files.read_token_files(token_files.write_token_files(docs, folder), folder).collect()
    assert len(got) == docs.count()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    at = 0
    for s, n in starts:
        assert s == at
        at += n
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    folder = new_path(spark, "none")
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), folder), folder).count() == 0


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 1000):
        ranks = rng.integers(0, [200, 1 << 16, 1 << 24, 1 << 31], (n, 4)).ravel()[:n].astype(np.uint32)
        block = token_files.encode_block(ranks)
        k, size = np.frombuffer(block[:8], "<u4")
        control = np.frombuffer(block[8: 8 + -(-n // 4)], np.uint8)
        assert k == n and (token_files.decode_block(n, control, np.frombuffer(block[8 + len(control):], np.uint8)) == ranks).all()
