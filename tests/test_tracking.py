"""Assignment against all matchings; motion, two passes, endings and clocks of tracks; folds however they are cut."""

import itertools
import random
import time

import numpy as np
import pytest

from tempora.operators import groups, tracking
from tempora.operators.tracking import Settings, Tracker

LIMIT = 0.8


def best_sum(cost):
    rows, columns = cost.shape
    gain = lambda i, j: LIMIT - cost[i, j] if cost[i, j] < LIMIT else 0
    if rows > columns:
        return best_sum(cost.T)
    return max((sum(gain(i, j) for i, j in enumerate(p)) for p in itertools.permutations(range(columns), rows)), default=0)


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        cost = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        if rng.random() < 0.4:
            cost = np.round(cost * 4) / 4  # ties
        pairs = tracking.assignment(cost, LIMIT)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert all(cost[i, j] < LIMIT for i, j in pairs)
        assert np.isclose(sum(LIMIT - cost[i, j] for i, j in pairs), best_sum(cost))
    assert tracking.assignment(np.full((2, 3), 0.9), LIMIT) == []


def test_the_best_matching_is_not_the_greedy_one():
    assert tracking.assignment(np.array([[0.1, 0.2], [0.2, 0.75]]), LIMIT) == [(0, 1), (1, 0)]


def followed(frames, settings=Settings()):
    """For each frame (track, place or None, left edge) of what a tracker says; frames: lists of (left, score), boxes 40 by 100."""
    t, out = Tracker(settings), []
    for rows in frames:
        boxes, scores = np.array([[x, 20.0, x + 40, 120] for x, _ in rows]).reshape(-1, 4), np.array([s for _, s in rows], float)
        out.append([(k.number, place, round(float(tracking.corners(k.value[None])[0, 0]), 1)) for k, place in t.step(boxes, scores)])
    return out


def test_a_hidden_box_moves_on_and_keeps_its_track():
    frames = [[(20 + 6 * i, 0.9)] for i in range(12)] + [[]] * 5 + [[(20 + 6 * i, 0.9)] for i in range(17, 20)]
    out = followed(frames)
    assert {n for rows in out for n, _, _ in rows} == {1}
    hidden = [rows[0] for rows in out[12:17]]
    assert all(place is None for _, place, _ in hidden)
    assert all(abs(x - (20 + 6 * i)) < 4 for i, (_, _, x) in enumerate(hidden, 12)) and hidden[0][2] < hidden[4][2] - 15
    assert out[17][0][1] == 0


def test_unsure_boxes_keep_a_track_in_view_but_begin_none():
    out = followed([[(20, 0.9)], [(21, 0.15)], [(22, 0.15)], [(23, 0.9)]])
    assert [(n, p) for rows in out for n, p, _ in rows] == [(1, 0)] * 4
    assert followed([[(20, 0.15)], [(21, 0.2)]]) == [[], []]
    assert [p for rows in followed([[(20, 0.9)], [(21, 0.1)], [(22, 0.9)]]) for _, p, _ in rows] == [0, None, 0]  # too unsure even for that
    # An unsure box never brings a lost track back.
    assert [p for rows in followed([[(20, 0.9)], [], [(20, 0.15)], [(20, 0.9)]]) for _, p, _ in rows] == [0, None, None, 0]


def test_a_box_that_comes_later_must_be_seen_twice():
    out = followed([[(20, 0.9)], [(20, 0.9), (300, 0.9)], [(20, 0.9), (301, 0.9)], [(20, 0.9)], [(20, 0.9), (500, 0.9)], [(20, 0.9)]])
    assert [sorted(n for n, _, _ in rows) for rows in out] == [[1], [1], [1, 2], [1, 2], [1, 2], [1, 2]]
    assert 3 not in {n for rows in out for n, _, _ in rows}


def test_a_lost_track_ends_and_its_number_is_not_used_again():
    s = Settings(buffer=3)
    out = followed([[(20, 0.9)], *[[]] * 5, [(20, 0.9)], [(20, 0.9)]], s)
    assert [[n for n, _, _ in rows] for rows in out] == [[1], [1], [1], [1], [], [], [], [2]]


def test_two_boxes_pass_each_other():
    frames = [[(20 + 8 * i, 0.9), (300 - 8 * i, 0.8)] for i in range(30)]
    out = followed(frames)
    assert all({(n, p) for n, p, _ in rows} <= {(1, 0), (2, 1), (1, None), (2, None)} for rows in out[:15])
    assert {n for rows in out for n, _, _ in rows} <= {1, 2}


def test_only_earlier_frames_decide():
    rng = random.Random(5)
    frames = [[(rng.randrange(0, 400, 20) + i, rng.choice([0.05, 0.15, 0.3, 0.9])) for _ in range(rng.randrange(4))] for i in range(40)]
    whole = followed(frames)
    for n in (1, 7, 23):
        assert followed(frames[:n]) == whole[:n]


def tables(spark, pts, cadence_cut=()):
    frames = spark.createDataFrame([(i, 1, t, i in cadence_cut) for i, t in enumerate(pts)], "frame_id long, episode_id long, pts_us long, cut boolean")
    boxes = spark.createDataFrame([(i, k, c, 20.0 + 6 * i + 200 * k, 20.0, 60.0 + 6 * i + 200 * k, 120.0, 0.9) for i in range(len(pts)) if i not in (3, 4) for k, c in ((0, "a"), (1, "b"))], "frame_id long, box int, class string, x1 double, y1 double, x2 double, y2 double, score double")
    return boxes, tracking.sessions(frames, 100)


def test_tracks_of_tables(spark, monkeypatch):
    pts = [100 * i for i in range(8)] + [2000, 2100, 2200]
    boxes, frames = tables(spark, pts, {6})
    want = sorted(map(tuple, tracking.track(boxes, frames, 100, 640, 480).collect()), key=str)
    seen = {(r[1], r[2], r[3], r[6]): (r[5], r[7]) for r in want}
    assert len(want) == 22 and {n for n, _ in seen.values()} == {1}
    assert {k[3] for k in seen if k[2] in (3, 4)} == {"predicted"} and {k[0] for k in seen} == {0, 1, 2}
    assert seen[0, "a", 4, "predicted"][1] > seen[0, "a", 3, "predicted"][1] > 32
    for rows, arrow in ((1, "1"), (3, "2")):
        monkeypatch.setattr(groups, "FOLDED_ROWS", rows)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
        try:
            assert sorted(map(tuple, tracking.track(boxes, frames, 100, 640, 480).collect()), key=str) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tracking.track(boxes.limit(0), frames, 100, 640, 480).count() == 0
    # What leaves the picture is cut off at its edge, and gone beyond it.
    assert max(r[9] for r in tracking.track(boxes, frames, 100, 75, 480).collect()) <= 75


@pytest.mark.parametrize("pts", [[0, 100, 148], [0, 100, 100], [0, 100, 202]])
def test_other_clocks_raise(spark, pts):
    boxes, frames = tables(spark, pts)
    with pytest.raises(Exception, match="cadence"):
        tracking.track(boxes, frames, 100, 640, 480).collect()
    boxes, frames = tables(spark, [0, 101, 200])
    assert tracking.track(boxes, frames, 100, 640, 480).count() == 6


def test_few_boxes_and_many_go_the_same_way(monkeypatch):
    """Plain numbers and arrays give the same tracks, to the last bit, also of boxes without height or with corners that aren't known."""
    rng = np.random.default_rng(8)
    for k in range(30):
        frames = []
        for i in range(10):
            low = rng.integers(0, 12, (int(rng.integers(0, 8)), 2)) * 20.0 + i
            boxes = np.hstack([low, low + rng.integers(k % 2, 6, low.shape) * 15.0])
            if k % 5 == 0 and len(boxes):
                boxes[0, k % 4] = np.nan
            frames.append((boxes, np.round(rng.random(len(boxes)), 1)))
        said = []
        for crowded in (400, 0):
            monkeypatch.setattr(tracking, "CROWDED", crowded)
            t = Tracker(Settings())
            said.append([[(x.number, place, x.score, *x.corners()) for x, place in t.step(*frame)] for frame in frames])
        assert repr(said[0]) == repr(said[1])


def test_the_time_of_a_small_frame():
    """Frames of two boxes, 4,000 of them: arrays of so few took over twice as long as is allowed here beside the machine's own pace."""
    boxes, scores = [[20.0, 20.0, 60.0, 120.0], [200.0, 20.0, 240.0, 120.0]], [0.9, 0.8]
    pace = []
    for _ in range(3):
        began = time.process_time()
        a, b = np.array(boxes), np.array(boxes)
        for _ in range(4000):
            tracking.overlaps(a, b)
        pace.append(time.process_time() - began)
    t, began = Tracker(Settings()), time.process_time()
    for _ in range(4000):
        t.step(np.array(boxes), np.array(scores))
    assert time.process_time() - began < 3 * min(pace)
