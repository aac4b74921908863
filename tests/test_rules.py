"""Clocks, as-of reads and three-valued rules."""

import pytest
from pyspark.sql import functions as F

from tempora.operators import asof, checks, integrity, rules

OBS = "observation_id string, stream_id string, episode_id long, value boolean, event_us long, available_us long, committed_us long"


def test_snapshot_at_and_before_the_commit(spark):
    seen = spark.createDataFrame([("a", "s", 1, False, 10, 20, 30), ("b", "s", 2, None, 10, 20, 30), ("c", "s", 3, True, 10, 10, 10), ("d", "s", 3, False, 10, 10, 10)], OBS)
    asked = spark.createDataFrame([(1, 10, 29), (1, 10, 30), (1, 11, 30), (2, 10, 30), (3, 10, 30)], "episode_id long, event_us long, as_of_us long")
    got = {(r[0], r[1], r[2]): (r["value"], r["status"]) for r in asof.snapshot(seen, asked, ["episode_id"]).collect()}
    assert got == {(1, 10, 29): (None, "no_visible_sample"), (1, 10, 30): (False, "supported"), (1, 11, 30): (None, "no_visible_sample"), (2, 10, 30): (None, "source_unknown"), (3, 10, 30): (None, "disagreeing_samples")}


def test_append_is_idempotent_and_guarded(spark):
    store = spark.createDataFrame([("a", "s", 1, True, 1, 2, 3)], OBS)
    new = spark.createDataFrame([("a", "s", 1, True, 1, 2, 3), ("b", "s", 1, True, 2, 3, 4)], OBS)
    fresh = asof.appended(store, new, ["value"], producer=None)
    assert [r[0] for r in fresh.collect()] == ["b"]
    assert asof.appended(store.union(fresh), new, ["value"]).count() == 0
    with pytest.raises(ValueError, match="changed content"):
        asof.appended(store, new.withColumn("value", F.lit(False)), ["value"])
    with pytest.raises(ValueError, match="latest"):
        asof.appended(store, new.withColumn("committed_us", F.lit(2).cast("long")).where("observation_id = 'b'"), ["value"])


def test_log_page(spark):
    log = spark.createDataFrame([(1, 200), (2, 400)], "seq int, available_us long")
    assert asof.log_page(log, 399, 0, 10).count() == 1
    assert [r["seq"] for r in asof.log_page(log, 400, 0, 1).collect()] == [1]
    with pytest.raises(ValueError):
        asof.log_page(log, 500, 0, 1, horizon_us=400)


def test_before_is_unknown_where_times_overlap(spark):
    pairs = spark.createDataFrame([(0, 5, 6, 9), (9, 12, 6, 9), (0, 7, 6, 9), (None, None, 6, 9)], "first_lo_us long, first_hi_us long, second_lo_us long, second_hi_us long")
    assert [r["status"] for r in rules.before(pairs).collect()] == ["PASS", "VIOLATION", "UNKNOWN", "UNKNOWN"]


def test_absence_needs_whole_coverage(spark):
    spans = spark.createDataFrame([(1, 1, 0, 100), (2, 2, 0, 100), (3, 3, 0, 100), (4, 4, 0, 100), (5, 5, 0, 500)], "span_id long, episode_id long, start_us long, end_us long")
    clock = ", available_us long, committed_us long"
    events = spark.createDataFrame([(3, 50, 60, 60, 60), (4, 95, 105, 105, 105)], "episode_id long, lo_us long, hi_us long" + clock)
    cover = spark.createDataFrame([(e, a, b, b, b) for e, a, b in [(1, 0, 60), (1, 50, 100), (2, 0, 40), (2, 41, 100), (5, 0, 500)]], "episode_id long, start_us long, end_us long" + clock)
    got = {r["span_id"]: (r["status"], r["reason"]) for r in rules.no_event_in(spans, events, cover, 200).collect()}
    assert got == {1: ("PASS", "covered_event_absence"), 2: ("UNKNOWN", "event_coverage_gap"), 3: ("VIOLATION", "prohibited_event_observed"), 4: ("UNKNOWN", "event_overlaps_interval_boundary"), 5: ("UNKNOWN", "interval_not_finished")}


def test_registry_takes_all_or_nothing(spark):
    cols = "episode_id string, split string, split_group string, video string, video_sha256 string"
    h = lambda c: c * 64
    registry = spark.createDataFrame([("e1", "train", "g1", "a.mp4", h("a"))], cols)
    good = spark.createDataFrame([("e1", "train", "g1", "a.mp4", h("a")), ("e2", "test", "g2", "b.mp4", h("b"))], cols)
    assert [r[0] for r in integrity.ingest(registry, good).collect()] == ["e2"]
    for bad in [("e3", "test", "g1", "c.mp4", h("c")), ("e3", "test", "g3", "c.mp4", h("a")), ("e3", "other", "g3", "c.mp4", h("c")), ("e3", "test", "g3", "../c.mp4", h("c")), ("e1", "train", "g1", "z.mp4", h("a"))]:
        with pytest.raises(ValueError):
            integrity.ingest(registry, spark.createDataFrame([bad], cols))
    with pytest.raises(ValueError):
        integrity.ingest(registry, good.withColumn("label", F.lit(1)))


def test_violations_name_the_rule(spark):
    seen = spark.createDataFrame([("a", None, None, 1, 2, 3), ("b", True, None, 5, 4, 6)], "observation_id string, value boolean, unknown_reason string, event_us long, available_us long, committed_us long")
    got = {(r["observation_id"], r["rule"]) for r in checks.violations(seen, checks.observation_rules(), "observation_id").collect()}
    assert got == {("a", "unknown_has_reason"), ("b", "clocks")}
