"""All rows of one table against all of another: both are packed into blocks, which meet on a grid of tasks in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of either side, and the most blocks of a side that one task of the grid takes.
LEFT_ROWS, RIGHT_ROWS = 512, 2048
LEFT_BLOCKS, RIGHT_BLOCKS = 64, 16


def _blocked(df: DataFrame, key: str, side: str, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{side}_block")).agg(F.collect_list(F.struct(*df.columns)).alias(side)), n


def _packed(df: DataFrame) -> DataFrame:
    """right: the rows of each Arrow batch as a list, where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RIGHT_ROWS):
                part = batch.slice(at, RIGHT_ROWS)
                rows = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["right"])

    return df.mapInArrow(run, f"right array<{df.schema.simpleString()}>")


def meeting(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left_block, left and right (lists of rows): each block of left with each of right. The key tells the rows of a side apart, so blocks are even.

    Where left is one block, which is counted, it goes to where the rows of right are, and nothing is shuffled.
    """
    if 0 < left.limit(LEFT_ROWS + 1).count() <= LEFT_ROWS:
        block = left.agg(F.collect_list(F.struct(*left.columns)).alias("left"))
        return _packed(right).crossJoin(F.broadcast(block)).select(F.lit(0).cast("long").alias("left_block"), "left", "right")  # one row
    (a, n_left), (b, n_right) = _blocked(left, key, "left", LEFT_ROWS), _blocked(right, key, "right", RIGHT_ROWS)
    wanted = 2 * left.sparkSession.sparkContext.defaultParallelism
    across = -(-n_left // LEFT_BLOCKS)
    down = min(n_right, max(-(-n_right // RIGHT_BLOCKS), -(-wanted // across)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = a.withColumn("i", F.pmod("left_block", F.lit(across))).withColumn("j", every(down))
    b = b.withColumn("j", F.pmod("right_block", F.lit(down))).withColumn("i", every(across))
    parts = min(across * down, 10_000)
    return a.repartition(parts, "i", "j").join(b.repartition(parts, "i", "j"), ["i", "j"]).select("left_block", "left", "right")


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray, pa.StructArray]]:
    """What meeting() gives, one pair of blocks after another."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        for row, block in enumerate(batch.column("left_block").to_pylist()):
            yield block, left[row].values, right[row].values


def matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, in double precision, and which of them are there; a missing vector is a row of zeros."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    there = lengths > 0
    width = int(lengths.max(initial=0))
    if (lengths[there] != width).any():
        raise ValueError("vectors of different lengths")
    out = np.zeros((len(lengths), width))
    out[there] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else 0
    return out, there
