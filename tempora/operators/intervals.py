"""Half-open intervals in whole microseconds: windows, grids, coverage and overlap.

Joins of intervals always have the episode as an equi-key, so they hash or sort by it and test the range inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND_US = 1_000_000


def tumbling(episodes: DataFrame, size_us: int) -> DataFrame:
    """Windows of one size from 0 on; the last one ends with the episode."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_us") - 1, F.lit(size_us).cast("long")))
    return episodes.select("episode_id", "duration_us", start.alias("start_us")).select("episode_id", "start_us", F.least(F.col("start_us") + size_us, "duration_us").alias("end_us"))


def trailing(episodes: DataFrame, width_us: int, stride_us: int) -> DataFrame:
    """Windows that end at every stride and at the episode's end, and reach back at most their width."""
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("duration_us") / stride_us))), lambda k: k * stride_us)
    ends = F.array_distinct(F.concat(F.filter(whole, lambda e: e < F.col("duration_us")), F.array("duration_us")))
    return episodes.select("episode_id", F.explode(ends).alias("end_us")).select("episode_id", F.greatest(F.lit(0), F.col("end_us") - width_us).cast("long").alias("start_us"), "end_us")


def sliding(episodes: DataFrame, width_us: int, stride_us: int) -> DataFrame:
    """Windows that start at every stride, of full width unless the episode ends before."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_us") - 1, F.lit(stride_us).cast("long")))
    return episodes.select("episode_id", "duration_us", start.alias("start_us")).select("episode_id", "start_us", F.least(F.col("start_us") + width_us, "duration_us").alias("end_us"))


def centred(moments: DataFrame, width_us: int) -> DataFrame:
    """A window of full width about centre_us, moved inside the source; null bounds where the source is shorter."""
    start = F.greatest(F.lit(0), F.least(F.col("centre_us") - width_us // 2, F.col("duration_us") - width_us)).cast("long")
    fits = F.col("duration_us") >= width_us
    return moments.withColumns({"start_us": F.when(fits, start), "end_us": F.when(fits, start + width_us)})


def members(windows: DataFrame, frames: DataFrame, *keep: str) -> DataFrame:
    """Frames inside each window; windows may overlap."""
    inside = (F.col("pts_us") >= F.col("start_us")) & (F.col("pts_us") < F.col("end_us"))
    return windows.join(frames.select("episode_id", "pts_us", *keep), "episode_id").where(inside)


def grid_sampled(frames: DataFrame, start_us: int, end_us: int, per_second: int) -> DataFrame:
    """Of each episode, the frames that come first at or after a point of the grid start + k / per_second.

    A frame is chosen if a point lies after the frame before it and not after itself: a comparison of two whole numbers for
    each frame, without a table of points.
    """
    before = F.lag("pts_us").over(W.partitionBy("episode_id").orderBy("pts_us"))
    points = lambda at: F.floor((at - start_us) * per_second / SECOND_US).cast("long")
    passed = F.when(before.isNull() | (before < start_us), -1).otherwise(points(before))
    inside = frames.withColumn("_passed", passed).where((F.col("pts_us") >= start_us) & (F.col("pts_us") < end_us))
    return inside.where(points(F.col("pts_us")) > F.col("_passed")).drop("_passed")


def deltas(frames: DataFrame) -> DataFrame:
    """For each episode: whether times rise strictly, the smallest and the largest step, and whether steps vary."""
    step = F.col("pts_us") - F.lag("pts_us").over(W.partitionBy("episode_id").orderBy("frame_index"))
    return frames.withColumn("step", step).groupBy("episode_id").agg(
        F.coalesce(F.min("step") > 0, F.lit(True)).alias("rising"), F.min("step").alias("least_step_us"), F.max("step").alias("most_step_us"), F.coalesce(F.min("step") != F.max("step"), F.lit(False)).alias("variable_rate")
    )


def islands(intervals: DataFrame, *keys: str) -> DataFrame:
    """Intervals merged where one begins no later than those before it end: keys, start_us, end_us."""
    order = W.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = intervals.withColumn("_new", F.when(reach.isNull() | (F.col("start_us") > reach), 1).otherwise(0))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_island")


def union_duration(intervals: DataFrame, *keys: str) -> DataFrame:
    """How long the union of the intervals lasts: each adds what lies beyond the furthest end before it."""
    order = W.partitionBy(*keys).orderBy("start_us", "end_us").rowsBetween(W.unboundedPreceding, -1)
    beyond = F.greatest(F.lit(0).cast("long"), F.col("end_us") - F.greatest("start_us", F.coalesce(F.max("end_us").over(order), F.col("start_us"))))
    return intervals.withColumn("_own", beyond).groupBy(*keys).agg(F.sum("_own").alias("covered_us"))


def gaps(intervals: DataFrame, *keys: str) -> DataFrame:
    """What lies uncovered between the first start and the last end."""
    merged = islands(intervals, *keys)
    following = F.lead("start_us").over(W.partitionBy(*keys).orderBy("start_us"))
    return merged.select(*keys, F.col("end_us").alias("gap_start_us"), following.alias("gap_end_us")).where("gap_end_us is not null")


def overlap_us(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def temporal_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = overlap_us(a_start, a_end, b_start, b_end)
    return F.try_divide(shared.cast("double"), (a_end - a_start + b_end - b_start - shared).cast("double"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of an episode's intervals that share time: columns of the right side are prefixed with r_."""
    other = right.select("episode_id", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "episode_id"])
    return left.join(other, "episode_id").where((F.col("start_us") < F.col("r_end_us")) & (F.col("r_start_us") < F.col("end_us")))
