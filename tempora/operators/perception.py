"""Boxes, tracks and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions import geometry as g

DIGITS = 6


def nearest(targets: DataFrame, people: DataFrame) -> DataFrame:
    """For each target box the person box of its frame with the nearest centre; of equals the lower box number."""
    p = people.select("frame_id", F.col("box").alias("person"), *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    d = F.round(g.centre_distance(g.box(), g.box("p_")), DIGITS)
    return targets.join(p, "frame_id").groupBy("frame_id", "box").agg(F.min(F.struct(d.alias("d"), "person")).alias("m")).select("frame_id", "box", "m.person", F.col("m.d").alias("squared_distance"))


def best_overlap(reviewed: DataFrame, detected: DataFrame) -> DataFrame:
    """For each reviewed box: the best IoU with a detection of its class in its frame, and how many of other classes overlap by half."""
    d = detected.select("frame_id", F.col("class").alias("d_class"), F.col("box").alias("d_box"), *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = reviewed.join(d, "frame_id", "left").where((F.col("d_box") != F.col("box")) | F.col("d_box").isNull())
    iou = F.coalesce(g.iou(g.box(), g.box("d_")), F.lit(0.0))
    same = F.col("d_class") == F.col("class")
    rows = pairs.groupBy("frame_id", "box").agg(F.round(F.max(F.when(same, iou)), DIGITS).alias("best_iou"), F.count_if(~same & (iou >= 0.5)).alias("wrong_class"))
    return reviewed.select("frame_id", "box").join(rows, ["frame_id", "box"], "left").select("frame_id", "box", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"), F.coalesce("wrong_class", F.lit(0)).alias("wrong_class"))


def unique_binding(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """The one candidate box of each frame, or null and whether there was none or more than one."""
    n = candidates.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.max("box").alias("_box"))
    rows = frames.select("frame_id").join(n, "frame_id", "left")
    status = F.when(F.col("n").isNull(), "missing_class").when(F.col("n") == 1, "unique_class").otherwise("ambiguous_instances")
    return rows.select("frame_id", F.when(F.col("n") == 1, F.col("_box")).alias("box"), status.alias("binding"))


def stratified(rows: DataFrame, hit: Column, *strata: str) -> DataFrame:
    """Recall over all rows and by each stratum alone, by grouping sets; the other strata are null there."""
    view = rows.select(*strata, hit.cast("int").alias("hit"))
    sets = [[], *[[F.col(s)] for s in strata]]
    return view.groupingSets(sets, *[F.col(s) for s in strata]).agg(F.count(F.lit(1)).alias("eligible"), F.sum("hit").alias("localized"), F.round(F.avg("hit"), DIGITS).alias("recall"))


def frame_change(frames: DataFrame, vector: str, keys: list[str], order: str) -> DataFrame:
    """Mean absolute difference of each frame's values from the frame's before; null for the first."""
    before = F.lag(vector).over(W.partitionBy(*keys).orderBy(order))
    gap = F.zip_with(F.col(vector), before, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return frames.withColumn("change", F.round(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(vector), DIGITS))


def proposals(frames: DataFrame, cues: dict[str, Column], bin_us: int = 1_000_000, periodic_bins: int = 3, per_window: int = 3, window_bins: int = 10) -> DataFrame:
    """Completed bins of each episode with the decision whether to look: every so many bins, and for cues while the budget lasts.

    A bin is complete when a later frame has come, so the last one is never given; it is available once that frame is and all
    of its own are. frames: episode_id, frame_index, pts_us, available_us.
    """
    binned = frames.withColumn("bin", F.floor(F.col("pts_us") / bin_us).cast("long"))
    rows = binned.groupBy("episode_id", "bin").agg(F.min("pts_us").alias("_first_us"), F.max("available_us").alias("_own"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), *[F.max(c.cast("int")).alias(f"_{n}") for n, c in cues.items()])
    order = W.partitionBy("episode_id").orderBy("bin")
    closed = rows.withColumn("_next", F.lead("_first_us").over(order)).where("_next is not null")
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{n}") == 1, F.lit(n)) for n in cues])))
    closed = closed.withColumns({"cues": reasons, "_periodic": F.col("bin") % periodic_bins == 0, "_window": F.floor(F.col("bin") / window_bins)})
    asks = closed.withColumn("_asks", (~F.col("_periodic") & (F.size("cues") > 0)).cast("int"))
    used = F.sum("_asks").over(W.partitionBy("episode_id", "_window").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    asks = asks.withColumn("_used", used)
    why = F.when(F.col("_periodic"), "periodic_full_scene").when((F.col("_asks") == 1) & (F.col("_used") <= per_window), "cue_budget").when(F.col("_asks") == 1, "budget_exhausted").otherwise("no_cue")
    return asks.select("episode_id", "bin", F.greatest("_next", "_own").alias("available_us"), "first_frame", "last_frame", F.array_join("cues", ",").alias("cues"), why.alias("decision"), why.isin("periodic_full_scene", "cue_budget").alias("selected"))


def bracket_coverage(brackets: DataFrame, packets: DataFrame) -> DataFrame:
    """For each reviewed bracket [start, end): how much of it selected packets cover, and whether they miss it wholly."""
    p = packets.select("episode_id", F.col("start_us").alias("p_start"), F.col("end_us").alias("p_end"))
    shared = F.greatest(F.lit(0).cast("long"), F.least("end_us", "p_end") - F.greatest("start_us", "p_start"))
    own = brackets.join(p, "episode_id", "left").groupBy("bracket_id", "episode_id").agg(F.coalesce(F.sum(shared), F.lit(0)).alias("covered_us"))
    return own.withColumn("missed", F.col("covered_us") == 0)
