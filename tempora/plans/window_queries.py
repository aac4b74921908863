"""Windows, grids and coverage over recorded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import intervals as iv
from tempora.sources import views
from tempora.sources.views import sql

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _frames(spark, sf_dir):
    return views.frames(spark, sf_dir)


def _episodes(spark, sf_dir):
    return views.episodes(_frames(spark, sf_dir))


def _spans(frames: DataFrame, length: int = 12 * HOUR_US) -> DataFrame:
    """An interval from each frame on, of a length that its value decides."""
    return frames.select("episode_id", "event_type", F.col("event_id").alias("span_id"), F.col("pts_us").alias("start_us"), (F.col("pts_us") + 1 + F.col("k") * (length // 100)).alias("end_us"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.tumbling(_episodes(spark, sf_dir), DAY_US)


def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.trailing(_episodes(spark, sf_dir), 2 * DAY_US, DAY_US)


def sliding_windows_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = iv.sliding(_episodes(spark, sf_dir), 2 * DAY_US, DAY_US)
    return iv.members(windows, _frames(spark, sf_dir), "value").groupBy("episode_id", "start_us", "end_us").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("value"), 6).alias("mean_value"))


def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = _frames(spark, sf_dir).select("episode_id", "event_id", F.col("pts_us").alias("centre_us")).join(_episodes(spark, sf_dir).select("episode_id", "duration_us"), "episode_id")
    return iv.centred(moments, 3 * DAY_US).select("event_id", "start_us", "end_us")


def grid_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow = _frames(spark, sf_dir).withColumn("pts_us", F.floor(F.col("pts_us") / 1000).cast("long"))  # a thousand times faster, so that the grid lets frames out
    return iv.grid_sampled(slow, 1_000_000, 2_000_000_000, 1).select("episode_id", "event_id", "pts_us")


def frame_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.deltas(_frames(spark, sf_dir))


def union_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_duration(_spans(_frames(spark, sf_dir)), "episode_id")


def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.islands(_spans(_frames(spark, sf_dir)), "episode_id")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gaps(_spans(_frames(spark, sf_dir)), "episode_id")


def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(_frames(spark, sf_dir))
    errors, sales = spans.where("event_type = 'error'"), spans.where("event_type = 'purchase'")
    both = iv.overlapping(errors, sales)
    shared = iv.overlap_us(F.col("start_us"), F.col("end_us"), F.col("r_start_us"), F.col("r_end_us"))
    return both.select("span_id", F.col("r_span_id").alias("other_id"), shared.alias("shared_us"))


def temporal_iou_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(_frames(spark, sf_dir))
    both = iv.overlapping(spans.where("event_type = 'error'"), spans.where("event_type = 'view'"))
    iou = iv.temporal_iou(F.col("start_us"), F.col("end_us"), F.col("r_start_us"), F.col("r_end_us"))
    return both.groupBy("span_id").agg(F.round(F.max(iou), 6).alias("best_iou"))


def unique_interval_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that lie in spans of purchases of one whole-hour length only: the length, if it is unique."""
    frames = _frames(spark, sf_dir)
    spans = _spans(frames).where("event_type = 'purchase'").withColumn("action", F.floor((F.col("end_us") - F.col("start_us")) / HOUR_US))
    clicks = frames.where("event_type = 'click'").select("episode_id", "event_id", "pts_us")
    inside = spans.select("episode_id", "start_us", "end_us", "action").join(clicks, "episode_id").where("pts_us >= start_us and pts_us < end_us")
    return inside.groupBy("event_id").agg(F.count_distinct("action").alias("n"), F.min("action").alias("action")).where("n = 1").select("event_id", "action")


QUERIES = {f.__name__: f for f in (tumbling_windows, trailing_windows, sliding_windows_members, centred_windows, grid_sampled_frames, frame_deltas, union_duration, coverage_islands, coverage_gaps, interval_overlap_pairs, temporal_iou_best, unique_interval_of_event)}

_DAY = DAY_US
_SPANS = f", spans AS (SELECT episode_id, event_type, event_id AS span_id, pts_us AS start_us, pts_us + 1 + k * {12 * HOUR_US // 100} AS end_us FROM frames)"
_ISLANDS = (
    _SPANS
    + """, marked AS (SELECT *, max(end_us) OVER (PARTITION BY episode_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked),
    islands AS (SELECT episode_id, min(start_us) AS start_us, max(end_us) AS end_us FROM numbered GROUP BY episode_id, island)"""
)

ORACLE_SQL = {
    "tumbling_windows": sql("episodes", body=f", s AS (SELECT episode_id, duration_us, unnest(range(0, duration_us, {_DAY})) AS start_us FROM episodes) SELECT episode_id, start_us, least(start_us + {_DAY}, duration_us) AS end_us FROM s"),
    "trailing_windows": sql("episodes", body=f", e AS (SELECT episode_id, unnest(list_append(range({_DAY}, duration_us, {_DAY}), duration_us)) AS end_us FROM episodes) SELECT episode_id, greatest(0, end_us - {2 * _DAY}) AS start_us, end_us FROM e"),
    "sliding_windows_members": sql(
        "episodes", body=f", s AS (SELECT episode_id, duration_us, unnest(range(0, duration_us, {_DAY})) AS start_us FROM episodes), w AS (SELECT episode_id, start_us, least(start_us + {2 * _DAY}, duration_us) AS end_us FROM s) SELECT w.episode_id, start_us, end_us, count(*) AS frames, round(avg(value), 6) AS mean_value FROM w JOIN frames f ON f.episode_id = w.episode_id AND pts_us >= start_us AND pts_us < end_us GROUP BY ALL"
    ),
    "centred_windows": sql(
        "episodes", body=f" SELECT event_id, CASE WHEN duration_us >= {3 * _DAY} THEN greatest(0, least(pts_us - {3 * _DAY // 2}, duration_us - {3 * _DAY})) END AS start_us, CASE WHEN duration_us >= {3 * _DAY} THEN greatest(0, least(pts_us - {3 * _DAY // 2}, duration_us - {3 * _DAY})) + {3 * _DAY} END AS end_us FROM frames JOIN episodes USING (episode_id)"
    ),
    "grid_sampled_frames": sql(
        "frames",
        body=""", f AS (SELECT episode_id, event_id, pts_us // 1000 AS p, lag(pts_us // 1000) OVER (PARTITION BY episode_id ORDER BY pts_us // 1000, event_id) AS q FROM frames)
        SELECT episode_id, event_id, p AS pts_us FROM f WHERE p >= 1000000 AND p < 2000000000 AND (p - 1000000) // 1000000 > CASE WHEN q IS NULL OR q < 1000000 THEN -1 ELSE (q - 1000000) // 1000000 END""",
    ),
    "frame_deltas": sql("frames", body=", d AS (SELECT episode_id, pts_us - lag(pts_us) OVER (PARTITION BY episode_id ORDER BY frame_index) AS step FROM frames) SELECT episode_id, coalesce(min(step) > 0, true) AS rising, min(step) AS least_step_us, max(step) AS most_step_us, coalesce(min(step) <> max(step), false) AS variable_rate FROM d GROUP BY episode_id"),
    "union_duration": sql("frames", body=_ISLANDS + " SELECT episode_id, CAST(sum(end_us - start_us) AS BIGINT) AS covered_us FROM islands GROUP BY episode_id"),
    "coverage_islands": sql("frames", body=_ISLANDS + " SELECT * FROM islands"),
    "coverage_gaps": sql("frames", body=_ISLANDS + ", g AS (SELECT episode_id, end_us AS gap_start_us, lead(start_us) OVER (PARTITION BY episode_id ORDER BY start_us) AS gap_end_us FROM islands) SELECT * FROM g WHERE gap_end_us IS NOT NULL"),
    "interval_overlap_pairs": sql("frames", body=_SPANS + " SELECT a.span_id, b.span_id AS other_id, least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) AS shared_us FROM spans a JOIN spans b ON a.episode_id = b.episode_id AND a.start_us < b.end_us AND b.start_us < a.end_us WHERE a.event_type = 'error' AND b.event_type = 'purchase'"),
    "temporal_iou_best": sql(
        "frames", body=_SPANS + ", p AS (SELECT a.span_id, least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) AS i, a.end_us - a.start_us + b.end_us - b.start_us AS u FROM spans a JOIN spans b ON a.episode_id = b.episode_id AND a.start_us < b.end_us AND b.start_us < a.end_us WHERE a.event_type = 'error' AND b.event_type = 'view') SELECT span_id, round(max(i / (u - i)), 6) AS best_iou FROM p GROUP BY span_id"
    ),
    "unique_interval_of_event": sql(
        "frames", body=_SPANS + f", p AS (SELECT c.event_id, (s.end_us - s.start_us) // {HOUR_US} AS action FROM spans s JOIN frames c ON c.episode_id = s.episode_id AND c.pts_us >= s.start_us AND c.pts_us < s.end_us WHERE s.event_type = 'purchase' AND c.event_type = 'click') SELECT event_id, min(action) AS action FROM p GROUP BY event_id HAVING count(DISTINCT action) = 1"
    ),
}
