import re

import corpus_pipeline
from tempora.llm import pii
from tempora.llm.common import stage

from tests.llm.test_exact_dedup import brute
from tests.llm.test_packing_sharding import checked
from tests.llm.test_simhash import slow_copies


def test_each_stage_against_its_own_input(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(apply(spark, docs, sf), "test-stage")
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.75 * len(before)
        elif name == "exact_dedup":
            assert set(after) == {i for i, _, _, kept in brute(list(before.items())) if kept}
        elif name == "near_dedup":
            ids = sorted(before)
            gone = slow_copies(ids, before, corpus_pipeline.RADIUS, corpus_pipeline.SHINGLE_WORDS)
            assert gone and set(after) == set(ids) - gone
        else:
            assert after == {i: pii.masked(t) for i, t in before.items()}
            assert not any(re.search(r"[\w.]+@[\w-]+\.\w", t) for t in after.values())
        if name != "personal_data":
            assert all(before[i] == t for i, t in after.items())
        docs = out
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    checked(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), library, texts)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 100
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_rows_pass_all_stages(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        for _, apply in corpus_pipeline.STAGES[:-1]:
            docs = stage(apply(spark, docs, sf), "odd-stage")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
