"""A causal multi-stage convolution over sequences of features: inference from given weights, whole or in chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators.groups import Columns, ddl, per_group


@dataclass
class Layer:
    """Three taps, `dilation` rows apart and none ahead, then a mix of channels."""

    taps: np.ndarray  # [3, channels in, channels out], the latest tap last
    tap_bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    dilation: int

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        padded = np.vstack([np.zeros((2 * self.dilation, x.shape[1])), x])
        seen = sum(padded[k * self.dilation : k * self.dilation + len(x)] @ self.taps[k] for k in range(3)) + self.tap_bias
        return (x + np.maximum(seen, 0) @ self.mix + self.mix_bias) * mask


@dataclass
class Stage:
    project: np.ndarray
    project_bias: np.ndarray
    layers: list[Layer]
    head: np.ndarray
    head_bias: np.ndarray

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = (x @ self.project + self.project_bias) * mask
        for layer in self.layers:
            h = layer(h, mask)
        return (h @ self.head + self.head_bias) * mask


def log_shares(logits: np.ndarray) -> np.ndarray:
    ahead = logits - logits.max(1, keepdims=True)
    return ahead - np.log(np.exp(ahead).sum(1, keepdims=True))


@dataclass
class Network:
    """Each stage refines the class shares of the one before. Rows that aren't valid count as zeros."""

    mean: np.ndarray
    scale: np.ndarray
    stages: list[Stage]

    @property
    def reach(self) -> int:
        """How many rows an output may depend on."""
        return 1 + sum(2 * layer.dilation for s in self.stages for layer in s.layers)

    def __call__(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """The logits of the last stage."""
        return self.outputs(x, valid)[-1]

    def outputs(self, x: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
        """The logits of every stage."""
        mask = valid[:, None].astype(float)
        x, out = (x - self.mean) / self.scale * mask, []
        for stage in self.stages:
            out.append(stage(x, mask))
            x = np.exp(log_shares(out[-1])) * mask
        return out

    @classmethod
    def random(cls, features: int, classes: int, channels: int = 16, layers: int = 3, stages: int = 2, seed: int = 0) -> Network:
        """Weights of a generator: for tests and as a shape to load weights into."""
        rng = np.random.default_rng(seed)
        w = lambda *shape: rng.normal(0, 0.3, shape)
        made = []
        for s in range(stages):
            blocks = [Layer(w(3, channels, channels), w(channels), w(channels, channels), w(channels), 2**i) for i in range(layers)]
            made.append(Stage(w(classes if s else features, channels), w(channels), blocks, w(channels, classes), w(classes)))
        return cls(np.zeros(features), np.ones(features), made)


class ChunkedNetwork:
    """Gives for rows as they come what the network gives for the whole, keeping only the rows that later ones depend on."""

    def __init__(self, network: Network):
        self.network, self.x, self.valid = network, None, None

    def push(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        if self.x is not None:
            x, valid, new = np.vstack([self.x, x]), np.concatenate([self.valid, valid]), len(x)
        else:
            new = len(x)
        keep = self.network.reach - 1
        out = self.network(x, valid)[len(x) - new :]
        self.x, self.valid = x[-keep:], valid[-keep:]
        return out


def loss_sums(logits: np.ndarray, target: np.ndarray, valid: np.ndarray, own: np.ndarray, clip: float, class_weights: np.ndarray) -> tuple[float, int, float, int]:
    """Over the rows that are one's own: the weighted cross entropy and the number of valid rows, and the squared change of log shares, clipped, and the number of values of valid neighbours."""
    log_p, counted = log_shares(logits), valid & own
    named = target[counted]
    if len(named) and (named.min() < 0 or named.max() >= logits.shape[1]):
        raise ValueError("a valid row's target is no class")
    entropy = -(log_p[counted, named] * class_weights[named]).sum()
    pairs = valid[1:] & valid[:-1] & own[1:]  # a pair is the later row's
    change = np.minimum(np.abs(np.diff(log_p, axis=0)), clip)[pairs]
    return float(entropy), int(counted.sum()), float((change**2).sum()), int(change.size)


def segmentation_loss(outputs: list[np.ndarray], target: np.ndarray, valid: np.ndarray, smooth_weight: float = 0.0, clip: float = 4.0, class_weights: np.ndarray | None = None) -> float:
    """The mean over stages of the cross entropy, a mean over valid rows, and of how much log shares change between valid neighbours; 0 without valid rows."""
    weights, every = np.ones(outputs[0].shape[1]) if class_weights is None else class_weights, np.ones(len(valid), bool)
    sums = [loss_sums(x, target, valid, every, clip, weights) for x in outputs]
    return float(np.mean([e / n + smooth_weight * (c / m if m else 0) if n else 0.0 for e, n, c, m in sums]))


def released_at(cells: DataFrame, order: str = "frame_index") -> DataFrame:
    """Adds released_us: cells are given in order, so one that is late holds back those after it."""
    so_far = W.partitionBy("episode_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("released_us", F.max("available_us").over(so_far))


#: Rows of a sequence that one task takes, besides those before it that they depend on.
BLOCK_ROWS = 4096


def in_blocks(cells: DataFrame, columns: list[str], order: str, block_rows: int, before: int) -> DataFrame:
    """Rows with _place in their episode, the block that they are of (_own) and a block that needs them (_block): that one, and those whose first rows come at most `before` rows after them."""
    place = F.row_number().over(W.partitionBy("episode_id").orderBy(order)).cast("long") - 1
    placed = cells.select("episode_id", order, *columns).withColumn("_place", place)
    placed = placed.withColumn("_last", F.floor(F.max("_place").over(W.partitionBy("episode_id")) / block_rows))
    own = F.floor(F.col("_place") / block_rows)
    needed = F.sequence(own, F.floor((F.col("_place") + before) / block_rows))
    return placed.select("*", own.alias("_own"), F.explode(needed).alias("_block")).where(F.col("_block") <= F.col("_last")).drop("_last")


def predict(cells: DataFrame, network: Network, features: str, valid: str, order: str = "frame_index", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """episode_id, order and state (null for rows that aren't valid) of each row.

    An episode is cut into blocks, each of which also gets the `reach - 1` rows before it; so no episode is ever held whole.
    """

    def run(group: Columns) -> list[tuple]:
        ok = np.array(group[valid], bool)
        best = network(np.array(group[features], float), ok).argmax(1).tolist()
        rows = zip(group["episode_id"], group[order], best, ok, group["_own"], group["_block"], strict=True)
        return [(e, o, b if v else None) for e, o, b, v, mine, block in rows if mine == block]

    dealt = in_blocks(cells, [features, valid], order, block_rows, network.reach - 1)
    return per_group(dealt, ["episode_id", "_block"], ["_place"], run, ddl(cells, "episode_id", order) + ", state int")


def loss(cells: DataFrame, network: Network, features: str, valid: str, target: str, smooth_weight: float = 0.0, clip: float = 4.0, class_weights: list[float] | None = None, order: str = "frame_index", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """stage, rows (valid ones), cross_entropy, smoothness and loss of each stage over all episodes; the network's loss is the mean of the stages'.

    A target is a class, and may be null where a row isn't valid. Blocks hand on sums, which are added up; neighbours are of one episode.
    """
    weights = np.ones(len(network.stages[-1].head_bias)) if class_weights is None else np.array(class_weights, float)

    def run(group: Columns) -> list[tuple]:
        ok, own = np.array(group[valid], bool), np.array(group["_own"]) == np.array(group["_block"])
        named = np.array([-1 if t is None else t for t in group[target]], np.int64)
        outputs = network.outputs(np.array(group[features], float), ok)
        return [(k, *loss_sums(x, named, ok, own, clip, weights)) for k, x in enumerate(outputs)]

    dealt = in_blocks(cells, [features, valid, target], order, block_rows, network.reach)
    sums = per_group(dealt, ["episode_id", "_block"], ["_place"], run, "stage int, entropy double, n long, change double, m long")
    total = sums.groupBy("stage").agg(F.sum("n").alias("rows"), F.sum("entropy").alias("entropy"), F.sum("change").alias("change"), F.sum("m").alias("m"))
    mean = lambda x, n: F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0))
    parts = total.select("stage", "rows", mean("entropy", "rows").alias("cross_entropy"), mean("change", "m").alias("smoothness"))
    return parts.withColumn("loss", F.when(F.col("rows") > 0, F.col("cross_entropy") + smooth_weight * F.col("smoothness")).otherwise(0.0))
