import corpus_pipeline
from tokenizers import Tokenizer

from tests.llm import test_near_dup, test_pii
from tests.llm.helpers import SCHEMA, docs_frame
from tests.llm.test_decontaminate import best_edits, words
from tests.llm.test_tokens import check_packing
from tidewright.llm import quality
from tidewright.llm.common import documents, staged
from tidewright.llm.tokens import tokenizer_path


def test_every_stage_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), name)
        outs.append(docs)
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for d in [documents(spark, sf), *outs[:4]]]
    for d in outs[:4]:
        assert d.columns == columns
    # quality: the base rules, and the verdict of the operator itself
    kept = {r["doc_id"] for r in quality.score(documents(spark, sf), quality.train(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))).collect() if r["kept"]}
    assert set(rows[1]) == kept and kept
    # near-duplicates: one of each group, five-word shingles
    want = test_near_dup.brute(list(rows[1].items()), 5)
    assert set(rows[2]) == {d for d, (_, c) in want.items() if c == d}
    # decontamination
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(rows[3]) == {d for d, t in rows[2].items() if not any(best_edits(i, words(t)) <= len(i) // 5 for i in items)}
    # personal data: none of the base patterns is left, and the rest of the text is
    assert set(rows[4]) == set(rows[3])
    for d, t in rows[4].items():
        assert not [s for s in test_pii.brute(t) if s.startswith(("email", "ip", "phone"))]
        if not test_pii.brute(rows[3][d]) and not any(c.isdigit() for c in rows[3][d]):
            assert t == rows[3][d]
    # packing
    check_packing(outs[4].collect(), list(rows[4].items()), Tokenizer.from_file(tokenizer_path()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, outs[4].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stages_take_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    odd = docs_frame(spark, [None, "", "a b"]).unionByName(spark.createDataFrame([(None, "word " * 80, None, None, None, "x")], SCHEMA))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.count()
            if name != "packing":
                assert out.columns == docs.columns


def test_stages_give_free_heap_back(spark, sf, monkeypatch):
    """The pipeline: executors kept the heap that near_duplicates had taken, beside the workers of later stages."""
    from tidewright.llm import common

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    garbage = [spark._jvm.java.nio.ByteBuffer.allocate(400 << 20) for _ in range(4)]
    for b in garbage:
        spark.sparkContext._gateway.detach(b)
    full = runtime.totalMemory()
    common.trim_heaps(spark)
    assert runtime.totalMemory() < full - (800 << 20)
    called = []
    monkeypatch.setattr(corpus_pipeline, "trim_heaps", called.append)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, common.documents(spark, sf).limit(0), sf)
    assert len(called) == len(corpus_pipeline.STAGES)
