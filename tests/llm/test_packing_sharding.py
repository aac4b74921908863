import random
import zlib
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tempora.llm import bpe, packing, sharding

from tests.llm.conftest import ODD


def test_a_pipelines_packing_leaves_nothing_in_its_worker(monkeypatch, library):
    """Workers live on for the stages that follow."""

    def stop(df, name):
        raise InterruptedError

    taken, batch = [], pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c", ""]})
    docs = SimpleNamespace(mapInArrow=lambda run, schema: taken.append(run))
    monkeypatch.setattr(packing, "identified", lambda docs: docs)
    monkeypatch.setattr(packing, "stage", stop)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    with pytest.raises(InterruptedError):
        corpus_pipeline.packed(None, docs, "")
    rows = [r for b in taken[0](iter([batch])) for r in b.to_pylist()]
    assert [r["length"] for r in rows] == [len(library.encode("a b c", add_special_tokens=False).ids) + 1, 1]
    assert bpe.chunk_cache.cache_info().currsize == bpe.codec.cache_info().currsize == 0


def checked(rows, library, texts, window=2048):
    """Every id lies in one piece; pieces lie gapless in their sequences; returns the share of windows that is filled."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"], r["start"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), window):
            part = ids[a : a + window]
            want.setdefault((i, len(ids), a), []).append((len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {k: sorted((r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return sum(r["length"] for r in rows) / (window * len(by_sequence))


def test_documents_are_packed_tightly(documents, library):
    rows = packing.pack(documents).collect()
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    filled = checked(rows, library, texts)
    tokens = sum(r["length"] for r in rows)
    assert filled >= tokens / (2048 * (-(-tokens // 2048) + 1))  # at most one window more than the tokens need


def test_odd_rows_and_empty_table(odd, nothing, library):
    checked(packing.pack(odd, keep_ids=True).collect(), library, [(i, t) for i, t, _ in ODD])
    assert packing.pack(nothing).count() == 0


def test_subset_sum_is_the_best_there_is():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(5)}
        room = rng.randint(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        taken = packing.closest_sum(counts, sorted(counts, reverse=True), room)
        assert sum(a * b for a, b in taken) == max(sums) and all(n <= counts[a] for a, n in taken)


def test_plan_uses_the_histogram_up():
    rng = random.Random(6)
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 257), 90)}
    plan = packing.minimum_slack_plan(counts, 256)
    used = {}
    for need, times in plan:
        assert sum(a * b for a, b in need) <= 256
        for a, b in need:
            used[a] = used.get(a, 0) + b * times
    assert used == counts


def test_shards(odd, nothing, documents):
    rows = sharding.with_slots(sharding.shard(odd)).collect()
    assert len(rows) == len(ODD)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["size"] == 16 + len((dict((i, t) for i, t, _ in ODD)[r["doc_id"]] or "").encode()) for r in rows if r["doc_id"] is not None)
    assert sharding.with_slots(sharding.shard(nothing)).count() == 0
    rows = sharding.with_slots(sharding.shard(documents)).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_share_the_keys(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' as text")
    n = {r["shard"]: r["count"] for r in sharding.shard(rows, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
