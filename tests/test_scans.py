"""Sequences decoded in blocks: the same however they are cut, equal to all paths; blocked cells; plain recursions beside it."""

import itertools

import numpy as np
import pytest

from tempora.operators import learning as ln
from tempora.operators import scans

TYPE = "run long, i long, scores array<double>"


def case(seed, runs=4, most=23, states=3, ties=True):
    rng = np.random.default_rng(seed)
    draw = (lambda *n: rng.integers(-3, 1, n).astype(float)) if ties else (lambda *n: rng.normal(size=n))
    a, pi = draw(states, states), draw(states)
    a[0, states - 1] = -np.inf
    rows = {}
    for run in range(runs):
        e = draw(int(rng.integers(1, most)), states)
        e[rng.random(e.shape) < 0.15] = -np.inf
        e[(e == -np.inf).all(1)] = 0
        e[:, 1] = np.where(np.isneginf(e[:, 1]), -4, e[:, 1])  # a way through is left
        rows[run if run else None] = e
    a[1, 1] = max(a[1, 1], -3)
    return rows, a, pi


def decoded(spark, rows, a, pi, method, block_rows):
    table = spark.createDataFrame([(run, i, x) for run, e in rows.items() for i, x in enumerate(e.tolist())], TYPE).repartition(3)
    got = scans.decode(table, ["run"], "scores", "i", method, a, pi, block_rows).collect()
    out = {run: [None] * len(e) for run, e in rows.items()}
    for r in got:
        out[r["run"]][r["i"]] = r["state"]
    assert len(got) == sum(map(len, rows.values()))
    return out


def uncut(rows, a, pi, method):
    of = {"viterbi": lambda e: ln.viterbi(e, a, pi)[0], "filter": lambda e: np.round(np.exp(ln.forward(e, a, pi)), 9).argmax(1), "smooth": lambda e: np.round(ln.smoothed(e, a, pi), 9).argmax(1)}
    return {run: of[method](e).tolist() for run, e in rows.items()}


@pytest.mark.parametrize("method", ["viterbi", "filter", "smooth"])
@pytest.mark.parametrize("block_rows", [1, 2, 7, 4096])
def test_blocks_give_the_uncut_result(spark, method, block_rows):
    rows, a, pi = case(block_rows)
    assert decoded(spark, rows, a, pi, method, block_rows) == uncut(rows, a, pi, method)
    rows, a, pi = case(50 + block_rows, ties=False)
    assert decoded(spark, rows, a, pi, method, block_rows) == uncut(rows, a, pi, method)


def test_blocks_equal_all_paths():
    """The product of steps holds, for each pair of states, what the best (or all) of the paths between them weigh."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        e, a, pi = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        for kind, add, join in ((np.float64, scans.log_sum, lambda w: np.log(np.exp(w).sum())), (np.int64, scans.largest, max)):
            args = [scans.whole(x) if kind is np.int64 else x for x in (e[None], a, pi)]
            got = scans.products(args[0], np.array([4]), args[1], args[2], add)[0] / (scans.UNIT if kind is np.int64 else 1)
            for begin, end in itertools.product(range(4), range(3)):
                weights = []
                for path in itertools.product(range(3), repeat=3):
                    states = [*path, end]
                    first = pi[states[0]] if begin == 3 else a[begin, states[0]]
                    weights.append(first + sum(e[t, s] for t, s in enumerate(states)) + sum(a[x, y] for x, y in itertools.pairwise(states)))
                assert np.isclose(got[begin, end], join(np.array(weights)), atol=1e-6)


def test_odd_scores_raise_and_empty_tables_do_not(spark):
    a, pi = np.full((2, 2), -0.7), np.full(2, -0.7)
    for method in ("viterbi", "filter", "smooth"):
        assert scans.decode(spark.createDataFrame([], TYPE), ["run"], "scores", "i", method, a, pi).count() == 0
        for bad, match in (([[0.0, float("nan")]], "below infinity"), ([[0.0, float("inf")]], "below infinity"), ([[0.0, 0.0], [-np.inf, -np.inf], [0.0, 0.0]], "path")):
            table = spark.createDataFrame([(1, i, x) for i, x in enumerate(bad)], TYPE)
            for block_rows in (1, 8):
                with pytest.raises(Exception, match=match):
                    scans.decode(table, ["run"], "scores", "i", method, a, pi, block_rows).collect()


def test_segments_with_blocked_cells_equal_all_segmentations():
    rng = np.random.default_rng(5)
    flat = np.zeros((2, 3))
    assert ln.segment_viterbi(np.array([[-np.inf, 0.0], [0.0, -5.0], [0.0, -5.0]]), np.zeros((2, 2)), np.zeros(2), flat)[0] == [(0, 1, 1), (1, 3, 0)]
    for _ in range(60):
        e, a, pi, d = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        e[rng.random(e.shape) < 0.3] = -np.inf
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=4):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [5]
            starts = [0, *ends[:-1]]
            if max(y - x for x, y in zip(starts, ends, strict=True)) <= 3:
                for states in itertools.product(range(3), repeat=len(ends)):
                    if all(x != y for x, y in itertools.pairwise(states)):
                        best = max(best, pi[states[0]] + sum(a[x, y] for x, y in itertools.pairwise(states)) + sum(e[x:y, k].sum() + d[k, y - x - 1] for x, y, k in zip(starts, ends, states, strict=True)))
        if best == -np.inf:
            with pytest.raises(ValueError, match="durations"):
                ln.segment_viterbi(e, a, pi, d)
        else:
            found, weight = ln.segment_viterbi(e, a, pi, d)
            assert np.isclose(weight, best) and all(np.isfinite(e[x:y, k]).all() for x, y, k in found)
