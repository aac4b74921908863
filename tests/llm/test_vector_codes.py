"""Codes against Lloyd's rounds by plain lists; bounds against full scans; odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from tempora.llm import vector_codes as v

TYPE = "vec_id long, embedding array<float>, label int"


def sound(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def slow(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in x], label) for i, x, label in rows if sound(x)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // parts
    cut = lambda x: [x[p * w : (p + 1) * w] for p in range(parts)]
    books = [list(c) for c in zip(*[cut(x) for _, x, _ in seeds], strict=True)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        codes = [[near(part, books[p]) for p, part in enumerate(cut(x))] for _, x, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(x)[p] for (_, x, _), c in zip(kept, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, labels = [], {}
    for i, x, label in kept:
        code = [near(part, books[p]) for p, part in enumerate(cut(x))]
        error = sum(far(part, books[p][code[p]]) for p, part in enumerate(cut(x)))
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
        labels[label] = labels.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[label]) for i, c, e, label in out), key=str), digest


def run(spark, rows, **how):
    found = v.compress(spark.createDataFrame(rows, TYPE).repartition(3), **how)
    got = v.with_label_errors(found.rows).selectExpr("vec_id", "lower(hex(codes))", "error", "label_error")
    return sorted((tuple(r) for r in got.collect()), key=str), found.digest(), found


@pytest.mark.parametrize(("seed", "n", "wide", "grain"), [(0, 120, 16, 4096), (1, 90, 32, 4), (2, 10, 8, 2), (3, 200, 16, 1)])
def test_lloyd_by_hand_with_ties(spark, seed, n, wide, grain):
    """Coarse grains make many equal distances and equal entries."""
    pick = random.Random(seed)
    rows = [(pick.choice([i, i, None]), [pick.randint(-2 * grain, 2 * grain) / 4096 for _ in range(wide)], pick.choice([0, 1, 2, None])) for i in range(n)]
    rows += rows[:7] + [(500, None, 0), (501, [None] * wide, 1), (502, [math.nan] * wide, 1), (-9, [math.inf] * wide, 1)]
    want, digest = slow(rows)
    got, found, _ = run(spark, rows)
    assert got == want
    assert found == digest


def test_bounds_say_what_a_scan_would():
    pick = np.random.default_rng(7)
    for grain in (1, 3, 1000):
        parts = pick.integers(-2 * grain, 2 * grain + 1, (500, 4))
        books = v.Codebooks(parts[:16].copy()[None])
        codes, upper, lower = v.scan(parts, books.entries[0])
        for _ in range(5):
            moved = books.entries + pick.integers(-grain // 2, grain // 2 + 2, books.entries.shape) * (pick.random(books.entries.shape[:2]) < 0.4)[:, :, None]
            books = v.Codebooks(moved, books.entries)
            scanned = v.assign(parts, books, 0, codes, upper, lower)
            d = ((parts[:, None] - moved[0][None]) ** 2).sum(-1)
            assert (codes == d.argmin(1)).all()
            own = np.sqrt(d[np.arange(500), codes])
            d[np.arange(500), codes] = 1 << 60
            assert (upper >= own).all() and (lower <= np.sqrt(d.min(1))).all()
            assert scanned < 500 or grain < 1000


def test_later_rounds_scan_less(spark):
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(16, 16))
    rows = [(i, [float(x) for x in centres[i % 16] + pick.normal(size=16) / 50], i % 3) for i in range(400)]
    _, _, found = run(spark, rows)
    assert found.scanned[0] == 400 * 8 and sum(found.scanned[1:]) < found.scanned[0]


def test_few_none_and_refused_rows(spark):
    for rows in ([], [(1, None, 1)], [(1, [math.nan] * 8, 1)]):
        assert run(spark, rows)[0] == []
    one = [(None, [0.5] * 8, None), (None, [0.5] * 8, None)]
    assert run(spark, one)[0] == slow(one)[0] == [(None, "0" * 16, 0, 0)] * 2
    assert run(spark, [(1, [], 1)])[0] == [(1, "0" * 16, 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [0.0] * 9, 1)])
    with pytest.raises(ValueError, match="too large"):
        run(spark, [(1, [1e9] * 8, 1)])
    with pytest.raises(ValueError, match="one length"):
        run(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)])


def test_other_columns_may_have_any_name(spark):
    rows = [(i, [i / 7, -i / 3] * 4, None) for i in range(20)]
    odd = spark.createDataFrame(rows, TYPE).selectExpr("*", *[f"'x' AS {c}" for c in ("vector", "codes", "upper", "lower", "errors", "sums", "scanned", "label_key", "error")])
    got = v.with_label_errors(v.compress(odd).rows)
    assert sorted(r["error"] for r in got.collect()) == sorted(r[2] for r in slow(rows)[0])
