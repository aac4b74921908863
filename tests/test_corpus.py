"""Artifacts, programs, packets, tracks and the convolution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import convolution, corpus, packets, tracking
from tempora.sources import artifacts


def test_action_interiors(spark):
    export = lambda *lines: spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "episode_id long, line_no long, line string")
    e = spark.createDataFrame([(1, 100, 10, 3)], "episode_id long, frames long, fps long, steps long")
    of = lambda *lines: corpus.action_interiors(corpus.action_rows(export(*lines)), e, 2)
    rows = of("0 walk 0 20", "", "0 WALK 20 23", "1 OPEN 30 60").orderBy("line_no").collect()
    assert [(r["action"], r["start_frame"], r["end_frame"], r["start_us"]) for r in rows] == [("WALK", 2, 18, 200_000), ("WALK", None, None, None), ("OPEN", 32, 58, 3_200_000)]
    for bad in (["0 walk 0"], ["9 walk 0 5"], ["0 walk 9 5"], ["0 walk 5 101"], ["0 walk 30 40", "1 open 20 50"], ["0 walk 0 30", "1 open 10 50"]):
        with pytest.raises(ValueError):
            of(*bad)


def test_fixed_windows(spark):
    e = spark.createDataFrame([(1, 50, "door", "interaction"), (2, 50, "posture", "interaction"), (3, 50, "door", "approach_only")], "episode_id long, frames long, family string, condition string")
    a = spark.createDataFrame([(1, 0, "WALK", 0, 9), (1, 1, "OPEN", 10, 20), (2, 0, "SIT", 20, 45)], "episode_id long, line_no long, action string, raw_start long, raw_end long")
    assert sorted(map(tuple, corpus.fixed_windows(e, a).collect())) == [(1, 5, 25, "OPEN"), (2, 25, 45, "SIT"), (3, 30, 50, "target_interaction_absent")]
    with pytest.raises(ValueError):
        corpus.fixed_windows(e.withColumn("frames", F.lit(10).cast("long")), a)


def test_scene_joins(spark):
    nodes = spark.createDataFrame([(1, 1, "kitchen", "Rooms", [], []), (1, 5, "fridge", "", ["CAN_OPEN"], ["CLOSED"]), (1, 4, "fridge", "", ["CAN_OPEN"], ["OPEN"]), (1, 3, "fridge", "", [], [])], "scene_id long, id long, class_name string, category string, properties array<string>, states array<string>")
    edges = spark.createDataFrame([(1, i, 1, "INSIDE") for i in (3, 4, 5)] + [(1, 9, 1, "INSIDE")], "scene_id long, from_id long, to_id long, relation_type string")
    assert corpus.openable_inside(nodes, edges, "kitchen", "fridge").first()["id"] == 4
    ask = lambda target, closed, room=1: corpus.endpoint_verdicts(spark.createDataFrame([(1, 9, target, room, closed)], "scene_id long, actor_id long, target_id long, destination_id long, expected_closed boolean"), nodes, edges)
    assert ask(5, True).first()["verdict"] == "PASS" and ask(4, False).first()["verdict"] == "VIOLATION"
    for bad in ((3, True), (5, False), (5, True, 2)):
        with pytest.raises(ValueError):
            ask(*bad)


def test_small_columns(spark):
    row = spark.range(1).select(corpus.reversed_frames(F.array(*map(F.lit, "abc"))), corpus.repeated_first(F.array(*map(F.lit, "ab"))), corpus.relative_positions(F.lit(6), (0.0, 0.5, 1.0)), F.array(*corpus.rotation([F.lit(0.0)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(1.0)]))).first()
    assert row[0] == ["c", "b", "a"] and row[1] == ["a", "a"] and row[2] == [0, 2, 5] and row[3][1] == pytest.approx(45)


def test_packets(spark):
    p = lambda ids, images=2, pixels=100: spark.createDataFrame([(1, 7, 0, 10, 10, ids, images, pixels)], "packet_id long, episode_id long, start_us long, end_us long, available_us long, evidence_ids array<string>, max_images int, max_pixels long")
    e = spark.createDataFrame([("a", 7, 5, 5, 5, 5), ("b", 7, 11, 11, 5, 5), ("c", 8, 5, 5, 5, 5), ("d", 7, 5, 30, 5, 5)], "evidence_id string, episode_id long, pts_us long, available_us long, width long, height long")
    of = lambda *a, **k: {r["rule"] for r in packets.packet_violations(p(*a, **k), e, 20).collect()}
    assert of(["a"]) == set() and of(["b"]) == {"future_or_outside"} and of(["c"]) == {"foreign_source"} and of(["d"]) == {"future_or_outside"}
    assert of(["x"]) == {"unknown_citation"} and of(["a", "a"], images=1, pixels=40) == {"image_budget", "pixel_budget"}
    answers = spark.createDataFrame([(1, True, ["a"], "x"), (1, True, [], "x"), (1, True, ["z"], "y" * 2001)], "packet_id long, value boolean, citations array<string>, explanation string")
    assert sorted(r["rule"] for r in packets.response_violations(answers, p(["a"])).collect()) == ["citations", "citations", "explanation"]
    reviews = spark.createDataFrame([(1, "visible", [1.0]), (2, "absent", None), (3, "absent", [1.0]), (4, "visible", None)], "sample_id long, visibility string, rectangle array<double>")
    assert {r["sample_id"] for r in packets.review_violations(reviews).collect()} == {3, 4}


def test_sessions(spark):
    f = spark.createDataFrame([(1, p, c) for p, c in [(0, False), (100, False), (260, False), (360, True), (460, False)]], "episode_id long, pts_us long, cut boolean")
    assert [r["shot"] for r in tracking.sessions(f, 100).orderBy("pts_us").collect()] == [0, 0, 1, 2, 2]


def test_convolution_is_causal_and_the_same_in_chunks():
    rng = np.random.default_rng(3)
    net = convolution.Network.random(4, 3, channels=5)
    x, valid = rng.normal(size=(60, 4)), rng.random(60) > 0.2
    whole = net(x, valid)
    later = x.copy()
    later[40:] += 5
    assert np.allclose(net(later, valid)[:40], whole[:40]) and not np.allclose(net(later, valid)[40:], whole[40:])
    stream = convolution.ChunkedNetwork(net)
    parts = [stream.push(x[a:b], valid[a:b]) for a, b in ((0, 1), (1, 7), (7, 30), (30, 60))]
    assert np.allclose(np.vstack(parts), whole)
    assert convolution.segmentation_loss([whole], np.zeros(60, int), np.zeros(60, bool)) == 0
    assert convolution.segmentation_loss([whole], whole.argmax(1), valid) < convolution.segmentation_loss([whole], whole.argmin(1), valid)


def test_publication_never_changes(spark, tmp_path):
    df, path = spark.range(5), f"file://{tmp_path}/table"
    assert artifacts.publish(df, path) and not artifacts.publish(df, path)
    with pytest.raises(ValueError):
        artifacts.publish(spark.range(6), path)


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    found = artifacts.file_hashes(spark, str(tmp_path))
    good = found.select(F.lit("a.bin").alias("name"), "sha256")
    root = f"file:{tmp_path}"
    assert artifacts.verified(good, found, root).count() == 0
    for folder in ("x", "y..z"):  # equal names in two folders, and dots that lead nowhere
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.bin").write_bytes(folder.encode())
    own = artifacts.file_hashes(spark, str(tmp_path))
    whole = own.select(F.regexp_replace("path", f"^{root}/", "").alias("name"), "sha256")
    assert whole.count() == 3 and artifacts.verified(whole, own, root).count() == 0 and artifacts.verified(spark.createDataFrame([("a.bin", "0")], "name string, sha256 string"), own, f"{root}/x").first()["status"] == "changed"
    bad = spark.createDataFrame([("a.bin", "0"), ("b.bin", "0"), ("../c", "0")], "name string, sha256 string")
    assert sorted(r["status"] for r in artifacts.verified(bad, own, root).collect()) == ["changed", "missing", "outside"]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "path string")
    ok = ["Action_0000_0_normal.png", "Action_0000_0_graph.json", "Action_0001_0_normal.png", "Action_0001_0_graph.json", "other.txt"]
    assert artifacts.frame_files(names(*ok)).count() == 2
    assert artifacts.frame_files(names(*[f"scene/{x}" for x in ok], "scene/XAction_0002_0_normal.png")).count() == 2
    for wrong in (ok[:3], [*ok[:2], "Action_0002_0_normal.png", "Action_0002_0_graph.json"], [*ok, "Action_0002_1_normal.png", "Action_0002_1_graph.json"]):
        with pytest.raises(ValueError):
            artifacts.frame_files(names(*wrong))


def test_populations(spark):
    s, y = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id long, x string"), spark.createDataFrame([(1, 0), (2, 1)], "sample_id long, y int")
    assert artifacts.joined_population(s, y, "sample_id").count() == 2
    for a, b in ((s, y.where("sample_id = 1")), (s.where("sample_id = 1"), y), (s.union(s), y)):
        with pytest.raises(ValueError):
            artifacts.joined_population(a, b, "sample_id")
    frames = spark.createDataFrame([(1,), (2,)], "frame_id long")
    boxes = spark.createDataFrame([(1, 0, "c", 0.5, 0.0, 0.0, 1.0, 1.0)], "frame_id long, box int, class string, score double, x1 double, y1 double, x2 double, y2 double")
    assert [len(r["boxes"]) for r in artifacts.detections_by_frame(frames, boxes).orderBy("frame_id").collect()] == [1, 0]
    with pytest.raises(ValueError):
        artifacts.detections_by_frame(frames.where("frame_id = 2"), boxes)
    rows = spark.createDataFrame([(1, "x", "s1"), (1, "x", "s2"), (2, "y", "s1")], "k long, v string, src string")
    merged = {r["k"]: r["aliases"] for r in artifacts.merged_sources([rows], ["k"], ["v"], "src").collect()}
    assert merged == {1: ["s1", "s2"], 2: ["s1"]}
    with pytest.raises(ValueError):
        artifacts.selected(spark.createDataFrame([(1, 0)], "episode_id long, frame_index long"), spark.createDataFrame([(1, 5)], "episode_id long, frame_index long"))
