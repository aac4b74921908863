"""Decoding of state sequences in blocks, so that one long sequence is work for many tasks.

A row of scores is a step from states to states, and steps are chained by a product: sums of weights along a path, and over the
paths the largest (Viterbi) or the log of the sum of exponentials (filtering, smoothing). The product is associative. So each
block of rows is multiplied out to one matrix by itself, the matrices of a sequence are folded from either end, which takes a
vector and one step a block, and blocks are then filled in from the vectors that enter them. Viterbi weights are whole numbers of
1 / UNIT, so that ties are ties however a sequence is cut.

A block is one row with arrays of at most as many rows as its range of order values holds; nothing else of a sequence is ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.groups import ddl, folded
from tempora.sources.staging import stage

#: Values of the order column that make a block.
BLOCK_ROWS = 2048
#: Parts of one in which Viterbi weights are counted, and the weight of what can't be.
UNIT, NEVER = 1 << 30, -(1 << 60)
#: Digits by which the most likely state is chosen; of equals it is the lowest.
DIGITS = 9

Add = Callable[[np.ndarray, int], np.ndarray]


def largest(x: np.ndarray, axis: int) -> np.ndarray:
    return np.maximum(x.max(axis), NEVER)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def whole(x: np.ndarray) -> np.ndarray:
    """Weights in whole numbers of 1 / UNIT; minus infinity is NEVER."""
    return np.where(np.isneginf(x), NEVER, np.rint(np.where(np.isneginf(x), 0, x) * UNIT)).astype(np.int64)


def checked(scores: np.ndarray) -> None:
    """Scores are logarithms: minus infinity is no way through, but not a number and infinity are faults."""
    if np.isnan(scores).any() or (scores == np.inf).any():
        raise ValueError("scores must be numbers below infinity")


def possible(weights: np.ndarray) -> bool:
    return bool((weights > NEVER // 2).any() if weights.dtype == np.int64 else np.isfinite(weights).any())


def padded(scores: list[list[list[float]]], states: int) -> tuple[np.ndarray, np.ndarray]:
    """The scores of blocks (blocks x rows x states, with zeros behind a block's end) and how many rows each has."""
    n = np.array([len(s) for s in scores], np.int64)
    out = np.zeros((len(scores), int(n.max()), states))
    flat = np.array([row for s in scores for row in s], float)
    checked(flat)
    out[np.arange(out.shape[1])[None] < n[:, None]] = flat
    return out, n


def products(e: np.ndarray, n: np.ndarray, transition: np.ndarray, initial: np.ndarray, add: Add) -> np.ndarray:
    """The product of each block's steps: from every state before it, and in the last row from the beginning of a sequence."""
    out = np.concatenate([transition[None] + e[:, 0, None], (initial + e[:, 0])[:, None]], 1)
    for t in range(1, e.shape[1]):
        on = n > t
        out[on] = add(out[on][..., None] + transition, -2) + e[on, t, None]
    return out


def best_paths(e: np.ndarray, n: np.ndarray, entry: list, transition: np.ndarray, initial: np.ndarray) -> list[tuple[list[list[int]], list[int]]]:
    """For each block the states of its rows, and the state before it, for each state that it may end in; of equal ways the lowest states."""
    blocks, rows, states = e.shape
    before = np.stack([np.full(states, NEVER) if v is None else np.array(v, np.int64) for v in entry])
    back = np.zeros((blocks, rows, states), np.int64)
    joint = before[:, :, None] + transition
    back[:, 0] = joint.argmax(1)
    best = np.where(np.array([v is None for v in entry])[:, None], initial, largest(joint, 1)) + e[:, 0]
    for t in range(1, rows):
        joint = best[:, :, None] + transition
        back[:, t] = joint.argmax(1)
        best = np.where((n > t)[:, None], largest(joint, 1) + e[:, t], best)
    out = []
    for b in range(blocks):
        at, path = np.arange(states), np.zeros((states, n[b]), np.int64)
        for t in range(n[b] - 1, -1, -1):
            path[:, t] = at
            at = back[b, t, at]
        out.append((path.tolist(), at.tolist()))
    return out


def posteriors(e: np.ndarray, n: np.ndarray, first: np.ndarray, transition: np.ndarray, after: np.ndarray | None) -> np.ndarray:
    """Log weights of the states of each row, given the rows so far, or all rows if `after` has what follows each block's end."""
    out, rows = np.zeros_like(e), e.shape[1]
    out[:, 0] = first + e[:, 0]
    for t in range(1, rows):
        out[:, t] = log_sum(out[:, t - 1][:, :, None] + transition, 1) + e[:, t]
    for b, end in enumerate(n):
        if not np.isfinite(out[b, :end].max(1)).all():
            raise ValueError("no path is admissible")
    if after is not None:
        ahead = after.copy()
        for t in range(rows - 1, -1, -1):
            here = n > t
            out[here, t] += ahead[here]
            ahead[here] = log_sum(transition[None] + (e[here, t] + ahead[here])[:, None], 2)
            # Only differences between states matter; the rest would grow with the sequence.
            ahead[here] -= np.where(np.isfinite(top := ahead[here].max(1, keepdims=True)), top, 0)
    return out


@dataclass
class Ahead:
    """Folds a sequence's blocks (keys, block, product) in order: gives the weights before each block (null before the first) and behind it."""

    key: tuple
    states: int
    sums: Add
    kind: type
    weights: np.ndarray | None = None

    def add(self, row: tuple) -> list[tuple]:
        block, product = row[len(self.key) :]
        m, entry = np.array(product, self.kind).reshape(self.states + 1, self.states), self.weights
        behind = m[-1] if entry is None else self.sums(entry[:, None] + m[:-1], 0)
        if not possible(behind):
            raise ValueError("no path is admissible")
        behind = behind - behind.max()
        self.weights = np.maximum(behind, NEVER) if self.kind is np.int64 else behind
        return [(*self.key, block, None if entry is None else entry.tolist(), self.weights.tolist())]

    def end(self) -> list[tuple]:
        return []


@dataclass
class Behind:
    """Folds a sequence's blocks (keys, block, product) from its end: gives the weights of all that follows each block's end."""

    key: tuple
    states: int
    weights: np.ndarray | None = None

    def add(self, row: tuple) -> list[tuple]:
        block, product = row[len(self.key) :]
        if self.weights is None:
            self.weights = np.zeros(self.states)
        after, m = self.weights, np.array(product).reshape(self.states + 1, self.states)
        before = log_sum(m[:-1] + after, 1)
        self.weights = before - (before.max() if np.isfinite(before.max()) else 0)
        return [(*self.key, block, after.tolist())]

    def end(self) -> list[tuple]:
        return []


@dataclass
class Back:
    """Folds a sequence's blocks (keys, block, leaving, came) from its end: gives the state that each block's path ends in."""

    key: tuple
    state: int | None = None

    def add(self, row: tuple) -> list[tuple]:
        block, leaving, came = row[len(self.key) :]
        ending = int(np.argmax(leaving)) if self.state is None else self.state
        self.state = came[ending]
        return [(*self.key, block, ending)]

    def end(self) -> list[tuple]:
        return []


def in_blocks(cells: DataFrame, keys: list[str], order: str, scores: str, block_rows: int) -> DataFrame:
    """keys, block, places (the order values) and scores of each block's rows, in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(scores).cast("array<double>").alias("s"))))
    grouped = cells.groupBy(*keys, F.floor(F.col(order) / block_rows).cast("long").alias("block")).agg(rows.alias("rows"))
    return grouped.select(*keys, "block", F.col("rows.o").alias("places"), F.col("rows.s").alias("scores"))


def beside(blocks: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with the columns that more has for each of them; null keys are keys like others."""
    renamed = more.select(*[F.col(c).alias(f"_{c}") for c in keys], *[c for c in more.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & blocks[c].eqNullSafe(renamed[f"_{c}"])
    return blocks.join(renamed, same).drop(*[f"_{c}" for c in keys])


def mapped(df: DataFrame, columns: list[str], added: str, make: Callable[[dict[str, list]], list[list]]) -> DataFrame:
    """These columns of df, and those that make gives for the lists of a batch's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = list(to_arrow_schema(StructType.fromDDL(added)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = make({c: b.column(c).to_pylist() for c in b.schema.names})
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *[pa.array(m, t.type) for m, t in zip(made, types, strict=True)]], [*columns, *[t.name for t in types]])

    return df.mapInArrow(run, f"{ddl(df, *columns)}, {added}")


def decode(cells: DataFrame, run_keys: list[str], scores: str, order: str, method: str, transition: np.ndarray, initial: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """run_keys, order and state of each row: by `filter` the most likely one given the rows of its run so far, by `smooth` given all of them, by `viterbi` that of the most likely path.

    order is a number, without repeats inside a run; rows with equal floor(order / block_rows) make a block. Of equally likely states the lowest counts, of equal paths that
    with the lowest states from the end on. Raises where no path is possible, and for scores that aren't numbers or are infinity.
    """
    if method not in ("filter", "smooth", "viterbi"):
        raise ValueError("unknown method")
    states, best = len(initial), method == "viterbi"
    kind, sums = (np.int64, largest) if best else (np.float64, log_sum)
    a, pi = (whole(transition), whole(initial)) if best else (transition, initial)
    listed = "array<long>" if best else "array<double>"
    at = [*run_keys, "block"]
    blocks = stage(in_blocks(cells, run_keys, order, scores, block_rows), "blocks")

    def weights(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        e, n = padded(rows["scores"], states)
        return (whole(e) if best else e), n

    def multiplied(rows: dict[str, list]) -> list[list]:
        return [products(*weights(rows), a, pi, sums).reshape(len(rows["scores"]), -1).tolist()]

    keys = ddl(blocks, *at)
    product = stage(mapped(blocks, at, f"product {listed}", multiplied), "block-products")
    ahead = folded(product, run_keys, ["block"], lambda key: Ahead(key, states, sums, kind), f"{keys}, entry {listed}, leaving {listed}")
    if best:

        def followed(rows: dict[str, list]) -> list[list]:
            return list(map(list, zip(*best_paths(*weights(rows), rows["entry"], a, pi), strict=True)))

        paths = stage(mapped(beside(blocks, ahead, at), [*at, "places", "leaving"], "paths array<array<int>>, came array<int>", followed), "block-paths")
        ends = folded(paths.select(*at, "leaving", "came"), run_keys, [F.desc("block")], lambda key: Back(key), f"{keys}, ending int")
        chosen = beside(paths.drop("leaving", "came"), ends, at).select(*run_keys, "places", F.element_at("paths", F.col("ending") + 1).alias("states"))
    else:
        entered = beside(blocks, ahead.drop("leaving"), at)
        if method == "smooth":
            entered = beside(entered, folded(product, run_keys, [F.desc("block")], lambda key: Behind(key, states), f"{keys}, after array<double>"), at)

        def filled(rows: dict[str, list]) -> list[list]:
            e, n = weights(rows)
            first = np.stack([initial if v is None else log_sum(np.array(v)[:, None] + transition, 0) for v in rows["entry"]])
            joint = posteriors(e, n, first, transition, np.array(rows["after"]) if method == "smooth" else None)
            share = np.exp(joint - log_sum(joint, 2)[..., None])
            return [[np.round(x[:k], DIGITS).argmax(1).tolist() for x, k in zip(share, n, strict=True)]]

        chosen = mapped(entered, [*run_keys, "places"], "states array<int>", filled)
    return chosen.select(*run_keys, F.explode(F.arrays_zip("places", "states")).alias("x")).select(*run_keys, F.col("x.places").alias(order), F.col("x.states").alias("state"))
