"""Automata against slow ones that walk from row to row, over random sequences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import scoring
from tempora.operators import sequences as sq


def walks(n, values, seed, least=1, most=40):
    """n random sequences: episode -> [(time, value)], with rising times."""
    rng, out = random.Random(seed), {}
    for e in range(n):
        at, rows = rng.randint(0, 50), []
        for _ in range(rng.randint(1, 30)):
            rows.append((at, rng.choice(values)))
            at += rng.randint(least, most)
        out[e] = rows
    return out


def table(spark, episodes, kind):
    return spark.createDataFrame([(e, i, p, x) for e, rows in episodes.items() for i, (p, x) in enumerate(rows)], f"episode_id long, frame_index long, pts_us long, x {kind}")


def column(df, name):
    return {(r["episode_id"], r["frame_index"]): r[name] for r in df.collect()}


def test_hysteresis(spark):
    episodes = walks(60, [0, 0, 0, 1, 1, 2, None], 11)
    got, want = column(sq.hysteresis(table(spark, episodes, "int"), "x", 45, 33), "state"), {}
    for e, rows in episodes.items():
        state = held = None
        since = before = 0
        for i, (p, x) in enumerate(rows):
            if x is None or (i and p - before > 33):
                state = held = None
            if x is not None and x != held:
                held, since = x, p
            if x is not None and p - since >= 45:
                state = held
            before, want[e, i] = p, -1 if x is None or state is None else state
    assert got == want and len(set(want.values())) > 2


def departures(rows, arm=3, absent=3):
    out, present, gone, armed = [], 0, [], False
    for i, x in rows:
        if x:
            present, gone = present + 1, []
            armed = armed or present >= arm
        else:
            present = 0
            if armed:
                gone.append(i)
                if len(gone) == absent:
                    out.append((gone[0], i))
                    gone, armed = [], False
    return out


def test_departures(spark):
    episodes = walks(80, [1, 1, 1, 0, 0], 7)
    got = sorted((r["episode_id"], r["first"], r["confirmation"]) for r in sq.departures(table(spark, episodes, "int"), F.col("x") == 1).collect())
    want = [(e, a, b) for e, rows in episodes.items() for a, b in departures([(i, x) for i, (_, x) in enumerate(rows)])]
    assert got == sorted(want) and len(want) > 10


def test_pauses_reset_departures(spark):
    episodes = walks(80, [1, 1, 1, 0, 0], 8, most=12)
    parts = sq.with_resets(table(spark, episodes, "int"), 10).withColumn("episode_id", F.concat_ws("/", F.col("episode_id").cast("string"), F.col("segment").cast("string")))
    got = sorted(r["first"] for r in sq.departures(parts, F.col("x") == 1).collect())
    want = []
    for rows in episodes.values():
        part = []
        for i, (p, x) in enumerate(rows):
            if i and p - rows[i - 1][0] > 10:
                want += [a for a, _ in departures(part)]
                part = []
            part.append((i, x))
        want += [a for a, _ in departures(part)]
    assert got == sorted(want) and want


def test_transitions_break_at_unknown_and_pauses(spark):
    episodes = walks(50, [0, 1, 2, None], 5)
    got = sorted((r["from_us"], r["to_us"]) for r in sq.transitions(table(spark, episodes, "int"), "x", 25).collect())
    want = [(p, q) for rows in episodes.values() for (p, x), (q, y) in zip(rows, rows[1:]) if x is not None and y is not None and x != y and q - p <= 25]
    assert got == sorted(want) and want


def test_persistence_gate(spark):
    episodes = walks(60, [0.05, 0.35, 0.55, 0.75, 0.95, 0.98], 3)
    got, want = column(sq.persistence_gate(table(spark, episodes, "double"), "x", 0.7, 0.3, 55), "state"), {}
    for e, rows in episodes.items():
        state, since = "normal", None
        for i, (p, x) in enumerate(rows):
            since = (p if since is None else since) if x >= 0.7 else None
            if x < 0.3:
                state = "normal"
            elif since is not None and state != "incident":
                state = "incident" if p - since >= 55 else "possible"
            want[e, i] = state
    assert got == want and set(want.values()) == {"normal", "possible", "incident"}


def test_identity_counts(spark):
    rng = random.Random(4)
    episodes = {e: [rng.choice("xyz") if rng.random() < 0.7 else None for _ in range(rng.randint(1, 12))] for e in range(40)}
    rows = spark.createDataFrame([(e, i, True, t) for e, seen in episodes.items() for i, t in enumerate(seen)], "episode_id long, i int, visible boolean, track string")
    for r in scoring.identity_counts(rows, ["episode_id"], "i").collect():
        seen = episodes[r["episode_id"]]
        known = [(i, t) for i, t in enumerate(seen) if t]
        switches = sum(a[1] != b[1] for a, b in zip(known, known[1:]))
        breaks = sum(b[0] - a[0] > 1 for a, b in zip(known, known[1:]))
        assert (r["id_switches"], r["fragmentations"], r["matched_rows"]) == (switches, breaks, len(known))
        assert math.isclose(r["visible_coverage"], len(known) / len(seen), abs_tol=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_abstention_gap(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random(), 2), rng.choice([-1, 0, 0, 1]), rng.choice([0, 0, 1])) for _ in range(30)]
    rows += [(2.0, -1, 0)] * (seed == 0)
    gap = scoring.abstention_gap(spark.createDataFrame(rows, "g double, t int, p int"), "g", "t", "p").first()["gap_threshold"]
    answered = [(t, p) for g, t, p in rows if g >= gap]
    assert all(t >= 0 for t, _ in answered)
    assert not answered or sum(t != p for t, p in answered) / len(answered) <= 0.2


def test_latency_is_never_interpolated(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(37)]
    r = scoring.latency_summary(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert r["count"] == 37 and r["p50"] in values and r["p95"] in values and r["max"] == max(values)
    assert sum(v < r["p50"] for v in values) == 18 and r["p50"] <= r["p95"] <= r["max"]


def test_order_and_what_may_have_been_missed(spark):
    needs = {"c": ["a", "b"], "b": ["a"]}
    episodes = walks(60, ["a", "b", "c"], 6)
    df = table(spark, episodes, "string").withColumn("gap", F.col("frame_index") == 4)
    got = {(r["episode_id"], r["frame_index"]): (r["missing"], r["status"]) for r in sq.out_of_order(df, needs, "x", ["episode_id"], "frame_index", F.col("gap")).collect()}
    want = {}
    for e, rows in episodes.items():
        for i, (_, x) in enumerate(rows):
            missing = [n for n in needs.get(x, []) if n not in {y for _, y in rows[: i + 1]}]
            if missing:
                want[e, i] = (missing, "uncertain" if i >= 4 else "wrong_order")
    assert got == want and want
