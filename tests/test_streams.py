"""Many episodes in a bucket: as each by itself says, with calls to the store that don't grow with episodes; ids of other kinds."""

import numpy as np
import pandas as pd
import pytest

from tempora.operators import convolution
from tempora.streaming import automata, replay


class State:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class Handle:
    def __init__(self):
        self.states = []

    def getValueState(self, name, schema):  # noqa: N802
        self.states.append(State())
        return self.states[-1]


NET = convolution.Network.random(2, 3, channels=4, layers=2, stages=2, seed=3)
MADE = {"departures": lambda: automata.Departures(2, 2, 50), "hysteresis": lambda: automata.Hysteresis(20, 60), "predictions": lambda: automata.Predictions(NET)}


def said(name, table, batches):
    """Rows by episode and frame, and the calls to the store a micro-batch."""
    processor, handle, out = MADE[name](), Handle(), []
    processor.init(handle)
    for part in batches:
        own = table.iloc[part]
        if len(own):
            out += [r for t in processor.handleInputRows((0,), iter([own.iloc[: len(own) // 2], own.iloc[len(own) // 2 :]]), None) for r in t.astype(object).where(t.notna(), None).itertuples(index=False, name=None)]
    return sorted(out, key=str), sum(s.calls for s in handle.states) / len(batches)


@pytest.mark.parametrize("name", sorted(MADE))
def test_a_bucket_says_what_its_episodes_say(name):
    rng = np.random.default_rng(4)
    rows = [(e, i, 10 * i + int(rng.integers(0, 9)), *rng.normal(size=2), bool(rng.random() > 0.3)) for e in range(60) for i in range(int(rng.integers(1, 40)))]
    table = pd.DataFrame(rows, columns=["episode_id", "frame_index", "pts_us", "a", "b", "valid"])
    table["features"] = table[["a", "b"]].to_numpy().tolist()
    table["x"] = table["valid"] if name == "departures" else (table["a"] > 0).astype(int).where(table["valid"])
    part = np.minimum(table["frame_index"].to_numpy() // 7, 3)
    if name == "predictions":  # cells may come in any order
        part = rng.integers(0, 4, len(table))
    mixed = rng.permutation(len(table))
    cut = lambda own: [own[part[own] == k] for k in range(4)]
    got, calls = said(name, table, cut(mixed))
    one_by_one = [said(name, table, cut(mixed[table["episode_id"].to_numpy()[mixed] == e]))[0] for e in range(60)]
    assert got == sorted((r for rows in one_by_one for r in rows), key=str) and got
    assert calls <= 6


def test_ids_that_are_missing_or_texts(spark):
    rows = [(e, i, 10 * i, i % 5 < 2) for e in ("a", None, "ü") for i in range(20)]
    table = spark.createDataFrame(rows, "episode_id string, frame_index long, pts_us long, x boolean")
    out = replay.replayed(table, "episode_id", "pts_us", [95], lambda s: automata.apply(s, automata.Departures(2, 2, None), buckets=1)).collect()
    assert sorted((str(r["episode_id"]), r["first"], r["confirmation"]) for r in out) == sorted((str(e), i, i + 1) for e in ("a", None, "ü") for i in (2, 7, 12, 17))
