"""Windows, grids and unions on the hand-computed values of the domain."""

from tempora.functions import geometry as g
from tempora.operators import intervals as iv
from pyspark.sql import functions as F


def triples(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def episode(spark, duration):
    return spark.createDataFrame([(1, duration)], "episode_id long, duration_us long")


def test_last_tumbling_window_is_clipped(spark):
    assert triples(iv.tumbling(episode(spark, 5_500_000), 2_000_000), "start_us", "end_us") == [(0, 2_000_000), (2_000_000, 4_000_000), (4_000_000, 5_500_000)]


def test_trailing_windows_and_members(spark):
    w = iv.trailing(episode(spark, 1000), 500, 300)
    assert triples(w, "end_us") == [(300,), (600,), (900,), (1000,)]
    f = spark.createDataFrame([(1, i, p) for i, p in enumerate([0, 100, 400, 900])], "episode_id long, frame_index long, pts_us long")
    inside = iv.members(w, f, "frame_index").groupBy("end_us").agg(F.array_sort(F.collect_list("frame_index")).alias("m"))
    assert triples(inside, "end_us", "m") == [(300, [0, 1]), (600, [1, 2]), (900, [2]), (1000, [3])]


def test_grid_of_a_variable_rate_clip(spark):
    f = spark.createDataFrame([(1, i, p * 1000) for i, p in enumerate([0, 100, 350, 450])], "episode_id long, frame_index long, pts_us long")
    assert triples(iv.grid_sampled(f, 0, 500_000, 5), "frame_index") == [(0,), (2,), (3,)]
    d = iv.deltas(f).first()
    assert d["rising"] and d["variable_rate"]


def test_grid_equals_brute_force(spark):
    import random

    random.seed(4)
    clips, want = [], set()
    for e in range(30):
        pts = sorted(random.sample(range(0, 3_000_000), 25))
        clips += [(e, i, p) for i, p in enumerate(pts)]
        k = 0
        while 200_000 + k * 1_000_000 / 7 < 2_500_000:
            later = [p for p in pts if (p - 200_000) * 7 >= k * 1_000_000 and p < 2_500_000 and p >= 200_000]
            want |= {(e, later[0])} if later else set()
            k += 1
    f = spark.createDataFrame(clips, "episode_id long, frame_index long, pts_us long")
    assert set(triples(iv.grid_sampled(f, 200_000, 2_500_000, 7), "episode_id", "pts_us")) == want


def test_union_and_gaps(spark):
    spans = spark.createDataFrame([(1, 0, 20), (1, 10, 30), (1, 40, 60)], "episode_id long, start_us long, end_us long")
    assert triples(iv.union_duration(spans, "episode_id"), "covered_us") == [(50,)]
    assert triples(iv.gaps(spans, "episode_id"), "gap_start_us", "gap_end_us") == [(30, 40)]
    assert triples(iv.islands(spans.where("start_us < 40").union(spark.createDataFrame([(1, 30, 35)], spans.schema)), "episode_id"), "start_us", "end_us") == [(0, 35)]


def test_centred_window(spark):
    m = spark.createDataFrame([(200, 5000), (4900, 5000), (500, 1000)], "centre_us long, duration_us long")
    assert [tuple(r)[2:] for r in iv.centred(m, 2000).collect()] == [(0, 2000), (3000, 5000), (None, None)]


def test_geometry(spark):
    b = g.Box(*map(F.lit, (100.0, 120.0, 180.0, 200.0)))
    wide = g.expand(b, 0.25, 640, 480)
    corner = g.expand(g.Box(*map(F.lit, (0.0, 0.0, 40.0, 20.0))), 0.25, 640, 480)
    iou = g.iou(g.Box(*map(F.lit, (0.0, 0.0, 20.0, 20.0))), g.Box(*map(F.lit, (10.0, 0.0, 30.0, 20.0))))
    back = g.out_of_crop(g.into_crop(b, wide, 2.0), wide, 2.0)
    row = spark.range(1).select(F.array(*wide), F.array(*corner), iou, F.array(*back), g.valid(g.Box(F.lit(5.0), F.lit(0.0), F.lit(5.0), F.lit(1.0)), 10, 10)).first()
    assert row[0] == [80, 100, 200, 220] and row[1] == [0, 0, 50, 25]
    assert abs(row[2] - 1 / 3) < 1e-9 and row[3] == [100, 120, 180, 200] and row[4] is False
