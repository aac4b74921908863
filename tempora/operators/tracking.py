"""Tracks of boxes: sessions that end at pauses and cuts, and inside them association by motion and overlap in two passes.

Every track carries a filter of constant velocity for its box's centre, aspect and height. In each frame the confident boxes are
matched with where the tracks, lost ones too, are expected; what is left of the tracks in view is then matched with the
unsure boxes, which never begin a track. A track that no box joins is lost, goes on moving as it did, and ends after `buffer`
frames. Only earlier frames decide, and a folder holds nothing but the tracks that are alive.

A frame shows a few boxes of a class as a rule, so what is done for each is done with plain numbers; arrays are for crowded frames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators.groups import ddl, folded
from tempora.operators.sequences import numbered_runs

TRACK = "track int, status string, x1 double, y1 double, x2 double, y2 double, score double"

#: What a filter's deviations are of a box's height, at first and from frame to frame, and those of its aspect.
POSITION, VELOCITY = 1 / 20, 1 / 160
ASPECT_POSITION, ASPECT_VELOCITY, ASPECT_SEEN = 1e-2, 1e-5, 1e-1
FIRST_POSITION, FIRST_VELOCITY = 2, 10


def sessions(frames: DataFrame, cadence_us: int) -> DataFrame:
    """Adds shot, which changes at a cut (cut, a boolean) and where frames lie more than one and a half cadences apart."""
    at = W.partitionBy("episode_id").orderBy("pts_us")
    pause = F.col("pts_us") - F.lag("pts_us").over(at) > cadence_us * 1.5
    return numbered_runs(frames, F.coalesce(pause | F.col("cut"), F.lit(False)), ["episode_id"], "pts_us", "shot")


@dataclass(frozen=True)
class Settings:
    """confident: the score from which a box may begin or join a track at first; unsure: that from which it may keep one in view.

    A pair is possible if 1 - overlap x score stays under first_cost (or fresh_cost, for tracks of one frame), and 1 - overlap
    under second_cost for unsure boxes. Boxes that two tracks share by this much are one; the track that began later goes.
    """

    confident: float = 0.25
    unsure: float = 0.1
    first_cost: float = 0.8
    second_cost: float = 0.5
    fresh_cost: float = 0.7
    same: float = 0.85
    buffer: int = 10


#: Pairs of boxes from which on arrays are quicker than plain numbers.
CROWDED = 400

Box = tuple[float, float, float, float]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every one of b; 0 where both are empty."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
    whole = area(a)[:, None] + area(b)[None] - shared
    return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)


def overlap_rows(a: list[Box], b: list[Box]) -> list[list[float]]:
    """The same, of boxes as plain numbers."""
    if len(a) * len(b) > CROWDED:
        return overlaps(np.array(a), np.array(b)).tolist()
    areas, rows = [(x[2] - x[0]) * (x[3] - x[1]) for x in b], []
    for p in a:
        p1, q1, p2, q2 = p
        area, row = (p2 - p1) * (q2 - q1), []
        for (x1, y1, x2, y2), own in zip(b, areas, strict=True):
            w = (p2 if p2 < x2 else x2) - (p1 if p1 > x1 else x1)
            h = (q2 if q2 < y2 else y2) - (q1 if q1 > y1 else y1)
            shared = w * h if w > 0 and h > 0 else 0.0
            whole = area + own - shared
            row.append(shared / whole if whole > 0 else 0.0)
        rows.append(row)
    return rows


def assignment(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of rows and columns, one to one, of cost under the limit, by which the sum of what the costs lie under it is largest."""
    return gainful(np.clip(limit - cost, 0, None).tolist())


def gainful(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of rows and columns, one to one, whose gains have the largest sum; those without gain are left out."""
    if not any(map(any, gain)):
        return []
    turned = len(gain) > len(gain[0])
    gain = [list(x) for x in zip(*gain, strict=True)] if turned else gain
    if len(gain) == 1:
        holder = [-1] * len(gain[0])
        holder[gain[0].index(max(gain[0]))] = 0
    elif len(gain) * len(gain[0]) > CROWDED:
        holder = _held_crowded(np.array(gain)).tolist()
    else:
        holder = _held(gain)
    pairs = [(r, c) for c, r in enumerate(holder) if r >= 0 and gain[r][c] > 0]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def _held(gain: list[list[float]]) -> list[int]:
    """The row that has each column, or -1, of at most as many rows as columns.

    Rows are placed one after another, each along the cheapest path of exchanges, kept cheap by prices of rows and columns.
    """
    columns = range(len(gain[0]))
    row_price, price, holder = [0.0] * len(gain), [0.0] * len(columns), [-1] * len(columns)
    for new in range(len(gain)):
        least, came, done = [math.inf] * len(columns), [-1] * len(columns), []
        row, column, along, left = new, -1, [new], list(columns)
        while True:
            own, paid, nearest, delta = gain[row], row_price[row], left[0], math.inf
            for c in left:
                step = -own[c] - paid - price[c]
                if step < least[c]:
                    least[c], came[c] = step, column
                if least[c] < delta:
                    nearest, delta = c, least[c]
            column = nearest
            for r in along:
                row_price[r] += delta
            for c in done:
                price[c] -= delta
            for c in left:
                least[c] -= delta
            done.append(column)
            left.remove(column)
            if holder[column] < 0:
                break
            row = holder[column]
            along.append(row)
        while column >= 0:  # back along the path, each column to the row before it
            before = came[column]
            holder[column] = holder[before] if before >= 0 else new
            column = before
    return holder


def _held_crowded(gain: np.ndarray) -> np.ndarray:
    """The same with arrays."""
    rows, columns = gain.shape
    row_price, price = np.zeros(rows), np.zeros(columns)
    holder = np.full(columns, -1)  # the row that has a column
    for new in range(rows):
        least, came, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, column, along = new, -1, [new]
        while True:
            step = -gain[row] - row_price[row] - price
            nearer = ~done & (step < least)
            least[nearer], came[nearer] = step[nearer], column
            column = int(np.where(done, np.inf, least).argmin())
            delta = least[column]
            row_price[along] += delta
            price[done] -= delta
            least[~done] -= delta
            done[column] = True
            if holder[column] < 0:
                break
            row = holder[column]
            along.append(row)
        while column >= 0:
            before = came[column]
            holder[column] = holder[before] if before >= 0 else new
            column = before
    return holder


def over(a: float, b: float) -> float:
    """a / b, and what floating point says where b is 0."""
    if b:
        return a / b
    return math.copysign(math.inf, a) * math.copysign(1.0, b) if a and not math.isnan(a) else math.nan


def measured(box: Box) -> Box:
    """Centre, aspect and height of corners."""
    x1, y1, x2, y2 = box
    return (x1 + x2) / 2, (y1 + y2) / 2, over(x2 - x1, y2 - y1), y2 - y1


def corners(state: np.ndarray) -> np.ndarray:
    half = np.column_stack([state[:, 2] * state[:, 3], state[:, 3]]) / 2
    return np.column_stack([state[:, :2] - half, state[:, :2] + half])


def variances(height: float, aspect: float, of_height: float) -> Box:
    own, other = of_height * height, aspect * aspect
    own *= own
    return own, own, other, own


class Track:
    """Four filters side by side, each of a value and its velocity, with their (co)variances; and what has been seen of the box."""

    __slots__ = ("number", "score", "began", "seen", "confirmed", "lost", "filters")

    def __init__(self, number: int, z: Box, score: float, frame: int, confirmed: bool):
        self.number, self.score, self.began, self.seen, self.confirmed, self.lost = number, score, frame, frame, confirmed, False
        var = variances(z[3], ASPECT_POSITION, FIRST_POSITION * POSITION)
        velocity_var = variances(z[3], ASPECT_VELOCITY, FIRST_VELOCITY * VELOCITY)
        #: value, velocity, variance, covariance and the velocity's variance
        self.filters = [(x, 0.0, v, 0.0, vv) for x, v, vv in zip(z, var, velocity_var, strict=True)]

    @property
    def value(self) -> np.ndarray:
        return np.array([f[0] for f in self.filters])

    def corners(self) -> Box:
        (x, *_), (y, *_), (aspect, *_), (height, *_) = self.filters
        w, h = aspect * height / 2, height / 2
        return x - w, y - h, x + w, y + h

    def predict(self) -> None:
        if self.lost:
            self.filters[3] = (self.filters[3][0], 0.0, *self.filters[3][2:])  # a box out of view doesn't grow
        height = self.filters[3][0]
        noise = zip(self.filters, variances(height, ASPECT_POSITION, POSITION), variances(height, ASPECT_VELOCITY, VELOCITY), strict=True)
        self.filters = [(x + v, v, var + 2 * both + vv + n, both + vv, vv + vn) for (x, v, var, both, vv), n, vn in noise]

    def join(self, z: Box, score: float, frame: int) -> None:
        noise, joined = variances(self.filters[3][0], ASPECT_SEEN, POSITION), []
        for (x, v, var, both, vv), n, seen in zip(self.filters, noise, z, strict=True):
            trust, pull, off = over(var, var + n), over(both, var + n), seen - x
            joined.append((x + trust * off, v + pull * off, var * (1 - trust), both * (1 - trust), vv - pull * both))
        self.filters = joined
        self.score, self.seen, self.confirmed, self.lost = score, frame, True, False


class Tracker:
    """The tracks of one class in one shot, frame by frame."""

    def __init__(self, settings: Settings):
        self.settings, self.tracks, self.frame, self.numbers = settings, [], 0, 0

    def step(self, boxes, scores) -> list[tuple[Track, int | None]]:
        """The tracks in view, each with the place of its box, and the lost ones with none, after one more frame. boxes and scores: arrays, or lists of the same."""
        if isinstance(boxes, np.ndarray):
            boxes, scores = boxes.tolist(), scores.tolist()
        s, frame = self.settings, self.frame
        self.frame += 1
        if not self.tracks and not scores:
            return []
        sure = [i for i, x in enumerate(scores) if x >= s.confident]
        unsure = [i for i, x in enumerate(scores) if s.unsure < x < s.confident]
        known, fresh = [t for t in self.tracks if t.confirmed], [t for t in self.tracks if not t.confirmed]
        for t in known:
            t.predict()
        joined: dict[int, int] = {}

        def match(tracks: list[Track], places: list[int], limit: float, by_score: bool) -> tuple[list[Track], list[int]]:
            if not tracks or not places:
                return tracks, places
            shared = overlap_rows([t.corners() for t in tracks], [boxes[p] for p in places])
            weights = [scores[p] if by_score else 1 for p in places]
            pairs = gainful([[max(limit - (1 - x * w), 0.0) for x, w in zip(row, weights, strict=True)] for row in shared])
            for i, j in pairs:
                tracks[i].join(measured(boxes[places[j]]), scores[places[j]], frame)
                joined[id(tracks[i])] = places[j]
            rows, columns = {i for i, _ in pairs}, {j for _, j in pairs}
            return [t for i, t in enumerate(tracks) if i not in rows], [p for j, p in enumerate(places) if j not in columns]

        left, sure = match(known, sure, s.first_cost, True)
        left, _ = match([t for t in left if not t.lost], unsure, s.second_cost, False)
        for t in left:
            t.lost = True
        gone, sure = match(fresh, sure, s.fresh_cost, True)
        if gone:
            dropped = set(map(id, gone))
            self.tracks = [t for t in self.tracks if id(t) not in dropped]
        for place in sure:  # boxes in view from the first frame on need no second sight
            self.numbers += 1
            self.tracks.append(Track(self.numbers, measured(boxes[place]), scores[place], frame, confirmed=not frame))
            joined[id(self.tracks[-1])] = place
        self.tracks = [t for t in self.tracks if not t.lost or frame - t.seen <= s.buffer]
        self._merge()
        return [(t, joined.get(id(t))) for t in self.tracks if t.confirmed]

    def _merge(self) -> None:
        here, lost = [t for t in self.tracks if t.confirmed and not t.lost], [t for t in self.tracks if t.lost]
        if here and lost:
            shared = overlap_rows(*([t.corners() for t in x] for x in (here, lost)))
            same = [(h, o) for h, row in zip(here, shared, strict=True) for o, x in zip(lost, row, strict=True) if x > self.settings.same]
            drop = {id(h if h.seen - h.began <= o.seen - o.began else o) for h, o in same}
            self.tracks = [t for t in self.tracks if id(t) not in drop]


class Shot:
    """A folder over the rows (keys, pts_us, frame_id, box, corners, score) of one class in one shot."""

    def __init__(self, key: tuple, settings: Settings, cadence_us: int, width: float, height: float):
        self.key, self.tracker, self.cadence_us, self.size = key, Tracker(settings), cadence_us, (float(width), float(height))
        self.at: int | None = None
        self.frame, self.rows = None, []

    def add(self, row: tuple) -> Iterator[tuple]:
        pts, frame, box, *rest = row[len(self.key) :]
        if self.frame is None or frame != self.frame:
            yield from self.end()
            if self.at is not None and abs(pts - self.at - self.cadence_us) > 1:
                raise ValueError(f"frames of a shot must follow each other by the cadence: {pts - self.at} us")
            self.at, self.frame, self.rows = pts, frame, []
        if box is not None:
            self.rows.append((box, *rest))

    def end(self) -> Iterator[tuple]:
        if self.frame is None or not (self.rows or self.tracker.frame):
            return  # a class is followed from the first frame that shows it
        rows = [[math.nan if x is None else x for x in r[1:6]] if None in r else r[1:6] for r in self.rows]
        (width, height), inside = self.size, lambda x, most: min(max(x, 0.0), most)
        for t, place in self.tracker.step([r[:4] for r in rows], [r[4] for r in rows]):
            x1, y1, x2, y2 = t.corners()
            x1, y1, x2, y2 = inside(x1, width), inside(y1, height), inside(x2, width), inside(y2, height)
            if x1 < x2 and y1 < y2:
                yield (*self.key, self.frame, None if place is None else self.rows[place][0], t.number, "predicted" if place is None else "observed", x1, y1, x2, y2, t.score)


def track(boxes: DataFrame, frames: DataFrame, cadence_us: int, width: float, height: float, settings: Settings = Settings()) -> DataFrame:
    """episode_id, shot, class, frame_id, box (null where only predicted), track, status, the filtered corners and the last score.

    boxes: frame_id, box, class, x1..y2, score; frames: frame_id, episode_id, shot, pts_us. Classes never share a track, nor do
    shots. Frames of a shot must follow each other by the cadence, to one microsecond, else the task raises. Corners are cut off
    at the frame's edges, and a track wholly outside gives no row. One task goes through a shot's boxes of one class.
    """
    classes = boxes.join(frames, "frame_id").select("episode_id", "shot", "class").distinct()
    own = frames.join(classes, ["episode_id", "shot"]).join(boxes, ["frame_id", "class"], "left")
    own = own.select("episode_id", "shot", "class", "pts_us", "frame_id", "box", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")])
    return folded(own, ["episode_id", "shot", "class"], ["pts_us", "frame_id", "box"], lambda key: Shot(key, settings, cadence_us, width, height), f"{ddl(own, 'episode_id', 'shot', 'class', 'frame_id')}, box int, {TRACK}")
