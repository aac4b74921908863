import re

import pytest
from pyspark.sql import functions as F

from tempora.llm import exact_dedup
from tempora.llm.common import stage

from tests.llm.conftest import NAMES, ODD


def brute(rows):
    """(doc_id, keep_id, group_size, kept) of each row, as a sorted list."""
    groups = {}
    for place, (i, t, *_) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, place))
    out = []
    for members in groups.values():
        best = min(members)
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), m == best) for m in members]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=repr)


def test_odd_rows(odd):
    assert found(exact_dedup.dedup(odd)) == brute(ODD)


def test_documents(documents):
    assert found(exact_dedup.dedup(documents)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(odd):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    assert found(exact_dedup.dedup(odd, weak)) == brute(ODD)


@pytest.mark.parametrize("from_files", [True, False])
def test_survivors_keep_their_columns(odd, from_files):
    left = exact_dedup.survivors(stage(odd, "odd") if from_files else odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((i for i, _, _, kept in brute(ODD) if kept), key=repr)
    values = {i: x for i, _, x in ODD}
    assert all(r[c] == values[r["doc_id"]] for r in rows if r["doc_id"] is not None for c in NAMES)


def test_locators_are_places_in_files(documents):
    assert exact_dedup.located(documents) is not None
    rows = exact_dedup.records(documents).select("locator.*").collect()
    assert sorted(r["row"] for r in rows) == list(range(len(rows))) and len({r["file"] for r in rows}) == 1


def test_hot_digests_are_joined_apart(odd, monkeypatch):
    from tempora.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert found(exact_dedup.dedup(odd)) == brute(ODD)


def test_more_hits_than_all_tasks_may_know(odd, monkeypatch):
    """Digests of very many rows go to all tasks, the others meet their texts in a join; unequal texts are found either way."""
    from tempora.llm import common

    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    for hot in (1, 3, 10**6):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert found(exact_dedup.dedup(odd, weak)) == brute(ODD)
        assert found(exact_dedup.dedup(odd)) == brute(ODD)


def test_empty_table(nothing):
    assert exact_dedup.dedup(nothing).count() == 0
    assert exact_dedup.survivors(nothing).count() == 0


def test_state_goes_on_from_its_checkpoint(spark, odd):
    from tempora.llm.common import new_path

    source, checkpoint, updates = (new_path(spark, n) for n in ("records", "state", "updates"))
    rows = exact_dedup.records(odd)
    rows.where("doc_id = 1").write.parquet(source)
    exact_dedup.keyed_state(spark, rows.schema, source, checkpoint, updates)
    rows.where("doc_id is null or doc_id != 1").write.mode("append").parquet(source)
    state = exact_dedup.keyed_state(spark, rows.schema, source, checkpoint, updates)
    assert sorted(r["n"] for r in state.collect()) == sorted(r["n"] for r in rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).collect())


def test_no_python_in_the_plan(documents):
    plan = exact_dedup.dedup(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
