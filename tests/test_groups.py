"""Groups that lie across Arrow batches are whole, and each comes once."""

import random

import pyarrow as pa

from tempora.operators import groups, retrieval
from tempora.operators.groups import per_group


def test_groups_across_batches(spark):
    rng = random.Random(1)
    rows = [(k, f"s{k % 3}", i, rng.random()) for k in range(40) for i in range(rng.randint(1, 60))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b string, i long, x double")
    want = sorted((k, f"s{k % 3}", [r[2] for r in sorted(rows) if r[0] == k]) for k in range(40))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = per_group(df, ["a", "b"], ["i"], lambda g: [(g["a"][0], g["b"][0], g["i"])], "a long, b string, i array<long>")
            assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert per_group(df.where("a < 0"), ["a"], ["i"], lambda g: [(1,)], "a long").count() == 0


def test_interval_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "a", 15, 25), (2, 1, "a", 20, 30), (3, 1, "a", 0, 5)], "query_id int, rank int, episode_id string, start_us long, end_us long")
    truths = spark.createDataFrame([(1, 0, "a", 10, 20), (1, 1, "b", 10, 20), (2, 2, "a", 10, 20)], "query_id int, truth_id int, episode_id string, start_us long, end_us long")
    got = {r["query_id"]: (r["success"], r["interval_recall"], r["best_iou"]) for r in retrieval.interval_metrics(hits, truths, [1]).collect()}
    assert got == {1: (1, 0.5, 0.333333), 2: (0, 0.0, 0.0), 3: (None, None, None)}


def test_columns_are_listed_as_arrow_lists_them():
    for values, kind in (([1, None, 2**60 + 1], pa.int64()), ([], pa.int32()), ([None], pa.float64()), ([0.5, None, float("inf")], pa.float64()), (["a", None], pa.string()), ([True, None], pa.bool_())):
        column = pa.array(values, kind)
        assert groups.listed(column) == column.to_pylist() and list(map(type, groups.listed(column))) == list(map(type, values))
        assert groups.listed(column.slice(1)) == column.slice(1).to_pylist()
