"""Decoders against all paths, matching, heads and text."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.functions import text as tx
from tempora.operators import learning as ln

def weight(path, e, a, pi):
    return pi[path[0]] + sum(e[t, s] for t, s in enumerate(path)) + sum(a[x, y] for x, y in itertools.pairwise(path))


@pytest.mark.parametrize("seed", range(8))
def test_hmm_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    n, k = rng.integers(1, 6), rng.integers(2, 4)
    e, a, pi = rng.normal(size=(n, k)), np.log(rng.dirichlet(np.ones(k), k)), np.log(rng.dirichlet(np.ones(k)))
    if seed % 2:
        a[0, 1] = -np.inf  # a step that can't be taken
    paths = list(itertools.product(range(k), repeat=int(n)))
    w = np.exp([weight(p, e, a, pi) for p in paths])
    best, score = ln.viterbi(e, a, pi)
    assert tuple(best) == paths[int(w.argmax())] and math.isclose(score, math.log(w.max()))
    marginal = np.array([[w[[p[t] == s for p in paths]].sum() for s in range(k)] for t in range(n)]) / w.sum()
    assert np.allclose(ln.smoothed(e, a, pi), marginal)
    assert np.allclose(np.exp(ln.forward(e, a, pi))[-1], marginal[-1])
    assert np.allclose(ln.forward(e[:-1], a, pi), ln.forward(e, a, pi)[:-1])  # what comes later changes nothing


@pytest.mark.parametrize("decode", [ln.forward, ln.smoothed, ln.viterbi, lambda e, a, pi: ln.segment_viterbi(e, a, pi, np.zeros((2, 3)))])
def test_faulty_scores_and_no_path_raise(decode):
    a, pi = np.full((2, 2), -0.7), np.full(2, -0.7)
    for bad in (np.nan, np.inf):
        with pytest.raises(ValueError, match="below infinity"):
            decode(np.array([[0.0, bad], [0.0, 0.0]]), a, pi)
    with pytest.raises(ValueError, match="path"):
        decode(np.array([[0.0, 0.0], [-np.inf, -np.inf], [0.0, 0.0]]), a, pi)


def test_segments_equal_all_segmentations():
    rng = np.random.default_rng(2)
    for _ in range(20):
        e, a, pi, d = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=4):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [5]
            starts = [0, *ends[:-1]]
            if max(b - s for s, b in zip(starts, ends)) > 3:
                continue
            for states in itertools.product(range(3), repeat=len(ends)):
                if any(x == y for x, y in itertools.pairwise(states)):
                    continue
                total = pi[states[0]] + sum(a[x, y] for x, y in itertools.pairwise(states)) + sum(e[s:b, k].sum() + d[k, b - s - 1] for s, b, k in zip(starts, ends, states))
                best = max(best, total)
        assert math.isclose(ln.segment_viterbi(e, a, pi, d)[1], best)


def test_matching_is_the_best_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        r = sorted((int(t), f"r{i}") for i, t in enumerate(rng.integers(0, 20, 4)))
        c = sorted((int(t), f"c{i}") for i, t in enumerate(rng.integers(0, 20, 4)))
        times = dict((b, a) for a, b in r + c)
        order = lambda n, xs: [y for y in itertools.permutations(xs, n) if list(y) == sorted(y)]
        best = (0, 0, [])
        for n in range(5):
            for x, y in itertools.product(order(n, r), order(n, c)):  # pairs that don't cross
                gaps = [abs(a[0] - b[0]) for a, b in zip(x, y)]
                if all(g <= 5 for g in gaps):
                    best = min(best, (-n, sum(gaps), [(a[1], b[1]) for a, b in zip(x, y)]))
        pairs = ln.matched_events(r, c, 5)
        assert (-len(pairs), sum(abs(times[a] - times[b]) for a, b in pairs), pairs) == best


def test_matching_takes_no_table():
    rows = [(i * 2, f"{i:05}") for i in range(1500)]
    assert ln.matched_events(rows, rows, 1) == [(i, i) for _, i in rows]


def test_segment_scores():
    rng = np.random.default_rng(6)
    for _ in range(40):
        labels = [rng.integers(-1, 3, 12).tolist() for _ in range(2)]
        valid, cuts = (rng.random(12) < 0.8).tolist(), np.cumsum(rng.integers(1, 9, 13)).tolist()
        spans = [ln.label_segments(x, valid, cuts[:-1], cuts[1:]) for x in labels]
        for x, own in zip(labels, spans):
            cells = [(a, b, k) for a, b, k, ok in zip(cuts, cuts[1:], x, valid) if ok and k >= 0]
            assert sum(b - a for a, b, _ in own) == sum(b - a for a, b, _ in cells) and all(a[1] < b[0] or a[2] != b[2] for a, b in itertools.pairwise(own))
        free, tp = list(spans[1]), 0
        for a, b, k in spans[0]:
            iou = lambda s: max(0, min(b, s[1]) - max(a, s[0])) / (max(b, s[1]) - min(a, s[0]) if min(b, s[1]) > max(a, s[0]) else 1)  # noqa: B023, E731
            of_label = sorted((s for s in free if s[2] == k), key=lambda s: -iou(s))
            if of_label and iou(of_label[0]) >= 0.4:
                free.remove(of_label[0])
                tp += 1
        got = ln.segment_scores(*spans, 0.4)
        assert (got["tp"], got["fp"], got["fn"]) == (tp, len(spans[0]) - tp, len(spans[1]) - tp)
        short = [s for s in spans[1] if s[1] - s[0] <= 6]
        few = ln.segment_scores(*spans, 0.4, 6)
        assert few["short"] == len(short) and few["short_recall"] == (sum(s not in free for s in short) / len(short) if short else None)


def test_class_weights_and_scales(spark):
    rows = spark.createDataFrame([(0, [1.0, 5.0]), (0, [3.0, 5.0]), (0, [5.0, 5.0]), (1, [7.0, 5.0]), (None, [0.0, 5.0])], "y int, v array<double>")
    assert {r["y"]: r["weight"] for r in ln.class_weights(rows, "y").collect()} == {0: 4 / 6, 1: 4 / 2}
    scales = {r["place"]: (r["mean"], r["scale"]) for r in ln.feature_scales(rows, "v").collect()}
    assert scales[1] == (5.0, 0.01) and math.isclose(scales[0][1], np.std([1, 3, 5, 7, 0]))


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    rows = spark.createDataFrame(pd.DataFrame({"v": x.tolist(), "y": y}))
    m = ln.fit_ridge(rows, "v", "y", 3)
    c, t = x - x.mean(0), np.eye(3)[y] - np.eye(3)[y].mean(0)
    assert np.allclose(m["weights"], np.linalg.solve(c.T @ c + 0.01 * np.eye(4), c.T @ t))
    with pytest.raises(ValueError):
        ln.fit_ridge(rows.where("y < 2"), "v", "y", 3)


def test_platt_is_ordered(spark):
    rows = spark.createDataFrame([(-2.0, False), (-1.0, False), (1.0, True), (2.0, True)], "s double, t boolean")
    p = [r[0] for r in rows.select(ln.platt(F.col("s"), ln.fit_platt(rows, "s", "t"))).collect()]
    assert p[0] < 0.5 < p[3] and p == sorted(p)


def test_answers(spark):
    parse = tx.strict_answer({"answer"}, "answer", {"yes", "no"})
    raws = ['{"answer": "yes"}', '{"answer": "yes", "answer": "no"}', '{"answer": NaN}', "yes", '{"answer": "maybe"}', '{"x": 1}', "[1]", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(parse("raw")).collect()]
    assert got == ["ok", "repeated_key", "not_json", "not_json", "other_value", "other_keys", "not_an_object", "missing"]


def test_fences_and_envelopes(spark):
    raws = ["```json\n{}\n```", "text", "```\n```", "<think>a</think>b", "<think>a b", "<think></think>b", "<think>x {\"a\": 1}"]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    rows = df.select(tx.unfenced(F.col("r")), tx.envelope(F.col("r"), "think")["status"], tx.recovered_envelope(F.col("r"), "think")).collect()
    assert [r[0] for r in rows][:3] == ["{}", "text", "```\n```"]
    assert [r[1] for r in rows][3:] == ["ok", "unbalanced_tags", "empty_part", "unbalanced_tags"]
    assert rows[4][2] == raws[4] and rows[6][2] == "<think>x </think>{\"a\": 1}"


def test_stream_is_the_batch_however_it_is_cut(spark, sf):
    from tempora.sources import views
    from tempora.streaming import automata, replay

    f = views.frames(spark, sf).select("episode_id", "frame_index", "pts_us", (F.col("value") >= 20).alias("x"))
    run = lambda cuts: sorted(map(tuple, replay.replayed(f, "episode_id", "pts_us", cuts, lambda s: automata.apply(s, automata.Departures(3, 3, None))).collect()))
    assert run([]) == run([10**11, 10**12, 2 * 10**12])
