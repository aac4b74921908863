"""The automata over frames as they arrive: constant state for each episode, kept in RocksDB.

Frames of an episode come in order; one that comes late is an error, as the commit clock never goes back. Episodes are dealt to
buckets, and a bucket's states are read and written together, once in a micro-batch: calls to the store don't grow with episodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of episodes. It belongs to a checkpoint: a stream that goes on from one needs as many.
BUCKETS = 1024


class Automaton(StatefulProcessor):
    """Walks through each episode's frames from the state that those before have left.

    A bucket's rows of a micro-batch are held together. A walk gets a state and a frame's index, time and x at a time, and returns
    the state after them and its rows. States are tuples of FIELDS; those of new episodes are START.
    """

    FIELDS: dict[str, str]
    START: tuple
    COLUMNS: list[str]
    episode_type = "long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = {"episode": self.episode_type} | self.FIELDS
        self.states = handle.getValueState("states", ", ".join(f"{k} array<{v}>" for k, v in fields.items()))

    def walk(self, state: tuple, rows: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        episodes, codes = numbered(table)
        known, *states = self.states.get() if self.states.exists() else ((),)
        held = dict(zip(known, zip(*states, strict=True), strict=False))
        order = np.lexsort((table["frame_index"].to_numpy(), codes))
        codes, table = codes[order], table.iloc[order]
        frames, times = table["frame_index"].tolist(), table["pts_us"].tolist()
        seen = [None if none else x for x, none in zip(table["x"].tolist(), table["x"].isna().tolist(), strict=True)]
        cuts, out = np.flatnonzero(np.diff(codes)) + 1, []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], strict=True):
            episode = episodes[codes[a]]
            state, said = self.walk(held.get(episode, self.START), zip(frames[a:b], times[a:b], seen[a:b], strict=True))
            held[episode] = state
            out += [(episode, *row) for row in said]
        self.states.update((list(held), *[list(x) for x in zip(*held.values(), strict=True)]))
        yield pd.DataFrame(out, columns=["episode_id", *self.COLUMNS])

    def close(self) -> None:
        pass


def numbered(table: pd.DataFrame) -> tuple[list, np.ndarray]:
    """The episodes of a table and the place of each row's among them. Rows without an episode have a bucket, and so a table, of their own."""
    if table["episode_id"].isna().any():
        return [None], np.zeros(len(table), np.int64)
    codes, episodes = pd.factorize(table["episode_id"])
    return episodes.tolist(), codes


def follows(frame: int, last: int) -> None:
    if frame <= last:
        raise ValueError(f"frame {frame} came after {last}")


class Departures(Automaton):
    """Armed after `arm` rows of presence, fires after `absent` rows without, for the first of these; a long pause forgets all."""

    FIELDS = {"present": "int", "gone": "int", "armed": "boolean", "first": "long", "first_us": "long", "last": "long", "last_us": "long"}
    START = (0, 0, False, -1, -1, -1, -1)
    COLUMNS = ["event_us", "available_us", "first", "confirmation"]

    def __init__(self, arm: int, absent: int, max_gap_us: int | None):
        self.arm, self.absent, self.max_gap_us = arm, absent, max_gap_us

    def walk(self, state: tuple, rows: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
        present, gone, armed, first, first_us, last, last_us = state
        out = []
        for frame, pts, seen in rows:
            follows(frame, last)
            if self.max_gap_us is not None and last >= 0 and pts - last_us > self.max_gap_us:
                present, gone, armed = 0, 0, False
            last, last_us = frame, pts
            if seen:
                present, gone = present + 1, 0
                armed = armed or present >= self.arm
                continue
            present = 0
            if not armed:
                continue
            if gone == 0:
                first, first_us = frame, pts
            gone += 1
            if gone == self.absent:
                out.append((first_us, pts, first, frame))
                gone, armed = 0, False
        return (present, gone, armed, first, first_us, last, last_us), out


class Hysteresis(Automaton):
    """The label that has last held for persistence_us, or -1; a missing label or a long pause forgets all."""

    FIELDS = {"current": "int", "candidate": "int", "since": "long", "last": "long", "last_us": "long"}
    START = (-1, -1, -1, -1, -1)
    COLUMNS = ["frame_index", "state"]

    def __init__(self, persistence_us: int, max_gap_us: int):
        self.persistence_us, self.max_gap_us = persistence_us, max_gap_us

    def walk(self, state: tuple, rows: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
        current, candidate, since, last, last_us = state
        out = []
        for frame, pts, label in rows:
            follows(frame, last)
            if label is None or (last >= 0 and pts - last_us > self.max_gap_us):
                current = candidate = -1
            last, last_us = frame, pts
            if label is not None:
                if label != candidate:
                    candidate, since = int(label), pts
                if pts - since >= self.persistence_us:
                    current = candidate
            out.append((frame, current if label is not None else -1))
        return (current, candidate, since, last, last_us), out


class Predictions(StatefulProcessor):
    """What a network says of cells that arrive as they become available, in whatever order: a cell waits for those before it.

    Kept of an episode are the cells that wait, and of those gone by only the `reach - 1` that later ones depend on. A cell is
    released when it and all before it are there; pts_us is when a cell is available. A bucket's episodes go through the network
    together, with rows between them that aren't valid and so count as the nothing before a first cell.
    """

    CELL = "place binary, frame binary, features binary, valid binary, available_us binary"
    episode_type = "long"

    def __init__(self, network):
        self.network = network
        self.gap = max((2 * layer.dilation for s in network.stages for layer in s.layers), default=0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", f"episode array<{self.episode_type}>, next array<long>, released_us array<long>")
        self.behind = handle.getValueState("behind", self.CELL)
        self.waiting = handle.getValueState("waiting", self.CELL)

    def _held(self, state) -> tuple[np.ndarray, ...]:
        """Cells in columns: place of the episode in the clock, frame, features, valid, available."""
        place, frame, features, valid, available = state.get() if state.exists() else (b"",) * 5
        whole = lambda x: np.frombuffer(x, np.int64)
        return whole(place), whole(frame), np.frombuffer(features).reshape(-1, len(self.network.mean)), np.frombuffer(valid, bool), whole(available)

    def _hold(self, state, cells: tuple[np.ndarray, ...]) -> None:
        state.update(tuple(c.tobytes() for c in cells))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        arrived, codes = numbered(table)
        episodes, following, released = map(list, self.clock.get()) if self.clock.exists() else ([], [], [])
        known = {e: i for i, e in enumerate(episodes)}
        places = np.array([known.setdefault(e, len(known)) for e in arrived], np.int64)
        episodes, new = list(known), len(known) - len(episodes)
        following, released = np.array([*following, *[0] * new], np.int64), np.array([*released, *[-1] * new], np.int64)
        own = places[codes], table["frame_index"].to_numpy(np.int64), np.array(table["features"].tolist(), np.float64).reshape(len(table), -1), table["valid"].to_numpy(bool), table["pts_us"].to_numpy(np.int64)
        cells = in_place(self._held(self.waiting), own)
        place, frame, _, valid, available = cells
        twice = frame < following[place]
        twice[1:] |= (np.diff(place) == 0) & (np.diff(frame) == 0)
        if twice.any():
            raise ValueError(f"cell {frame[twice][0]} came twice")
        count = np.bincount(place, minlength=len(episodes))
        since = np.arange(len(place)) - (np.cumsum(count) - count)[place]
        ready = frame - since == following[place]  # up to the first that is missing
        state = np.zeros(0, np.int64)
        at = released[place]
        if ready.any():
            taken = np.zeros(len(episodes), bool)
            taken[place[ready]] = True
            behind = self._held(self.behind)
            old = taken[behind[0]]
            seen = in_place(tuple(c[old] for c in behind), tuple(c[ready] for c in cells))
            state = self._states(seen)[seen[1] >= following[seen[0]]]
            left = np.bincount(seen[0], minlength=len(episodes))
            kept = np.cumsum(left)[seen[0]] - np.arange(len(seen[0])) < self.network.reach
            self._hold(self.behind, tuple(np.concatenate([a[~old], b[kept]]) for a, b in zip(behind, seen, strict=True)))
            at = np.maximum(at, pd.Series(available).groupby(place).cummax().to_numpy())
            np.maximum.at(released, place[ready], available[ready])
            following += np.bincount(place[ready], minlength=len(episodes))
        if ready.all():
            self.waiting.clear()
        else:
            self._hold(self.waiting, tuple(c[~ready] for c in cells))
        self.clock.update((episodes, following.tolist(), released.tolist()))
        said = pd.array(state, "Int32")
        said[~valid[ready]] = pd.NA
        yield pd.DataFrame({"episode_id": [episodes[i] for i in place[ready].tolist()], "frame_index": frame[ready], "state": said, "released_us": at[ready]})

    def _states(self, cells: tuple[np.ndarray, ...]) -> np.ndarray:
        """The likeliest class of each cell; cells lie by episode and frame."""
        place, _, features, valid, _ = cells
        begins = np.r_[True, np.diff(place) != 0]
        row = np.arange(len(place)) + self.gap * (np.cumsum(begins) - 1)
        x, ok = np.zeros((row[-1] + 1, features.shape[1])), np.zeros(row[-1] + 1, bool)
        x[row], ok[row] = features, valid
        return self.network(x, ok).argmax(1)[row]

    def close(self) -> None:
        pass


def in_place(*tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Cells of several tables by episode and frame."""
    cells = [np.concatenate(c) for c in zip(*tables, strict=True)]
    order = np.lexsort((cells[1], cells[0]))
    return tuple(c[order] for c in cells)


OUTPUT = {
    Predictions: "episode_id {0}, frame_index long, state int, released_us long",
    Departures: "episode_id {0}, event_us long, available_us long, first long, confirmation long",
    Hysteresis: "episode_id {0}, frame_index long, state int",
}


def apply(frames: DataFrame, processor: StatefulProcessor, buckets: int = BUCKETS) -> DataFrame:
    """Runs a processor over streamed frames: episode_id, frame_index, pts_us (for predictions, when the frame is available) and x or features and valid, what the processor reads."""
    kind = frames.schema["episode_id"].dataType.simpleString()
    processor.episode_type = kind
    bucket = F.when(F.col("episode_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("episode_id"), F.lit(buckets))).alias("bucket")
    dealt = frames.select("*", bucket).groupBy("bucket")
    return dealt.transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(OUTPUT[type(processor)].format(kind)), outputMode="Append", timeMode="None")
