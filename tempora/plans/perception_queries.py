"""Boxes, bindings and proposals; a frame is an order, its boxes are the order's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import geometry as g
from tempora.operators import checks
from tempora.operators import perception as p
from tempora.sources import views
from tempora.sources.views import sql

HOUR_US = 3_600_000_000
WIDTH, HEIGHT = 640, 480


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box widened by a quarter, its size class, and its corner in the coordinates of the widened crop."""
    d = views.detections(spark, sf_dir)
    wide = g.expand(g.box(), 0.25, WIDTH, HEIGHT)
    inner = g.into_crop(g.box(), wide)
    return d.select("frame_id", "box", *[c.cast("long").alias(f"w_{n}") for n, c in zip(("x1", "y1", "x2", "y2"), wide, strict=True)], g.size_class(g.box()).alias("size"), F.round(inner.x1, 4).alias("inner_x1"))


def box_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.violations(views.detections(spark, sf_dir), checks.box_rules(500, 120), "frame_id", "box")


def accepted_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir).where("score >= 0.75")
    return d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))


def nearest_neighbor_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    return p.nearest(d.where("class = 'N'"), d.where("class = 'R'"))


def box_iou_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    return p.best_overlap(d, d)


def unique_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))
    return p.unique_binding(frames, views.detections(spark, sf_dir).where("class = 'A' and score >= 0.75"))


def stratified_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a unique box, over all and by the order's status and priority."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    bound = unique_binding(spark, sf_dir).join(orders, "frame_id")
    return p.stratified(bound, F.col("binding") == "unique_class", "status", "priority")


def frame_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.frame_change(views.chunks(spark, sf_dir), "vector", ["episode_id"], "chunk_id").select("chunk_id", "change")


def _cued(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    return f.withColumn("available_us", F.col("pts_us") + F.col("k") * 10_000)


def causal_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.proposals(_cued(spark, sf_dir), {"movement": F.col("value") >= 70, "proximity": F.col("event_type") == "click"}, bin_us=12 * HOUR_US)


def uniform_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.proposals(_cued(spark, sf_dir), {"movement": F.col("value") >= 70}, bin_us=12 * HOUR_US, periodic_bins=1).select("episode_id", "bin", "decision", "selected")


def bracket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the six hours about each error the selected bins cover."""
    picked = causal_proposals(spark, sf_dir).where("selected").select("episode_id", (F.col("bin") * 12 * HOUR_US).alias("start_us"), ((F.col("bin") + 1) * 12 * HOUR_US).alias("end_us"))
    brackets = views.frames(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("bracket_id"), "episode_id", (F.col("pts_us") - 3 * HOUR_US).alias("start_us"), (F.col("pts_us") + 3 * HOUR_US).alias("end_us"))
    return p.bracket_coverage(brackets, picked)


QUERIES = {f.__name__: f for f in (box_geometry, box_violations, accepted_detections, nearest_neighbor_box, box_iou_best, unique_binding, stratified_recall, frame_change, causal_proposals, uniform_proposals, bracket_coverage)}

_BIN = 12 * HOUR_US
_BINS = f""", b AS (SELECT episode_id, pts_us // {_BIN} AS bin, min(pts_us) AS first_us, max(pts_us + k * 10000) AS own, min(frame_index) AS first_frame, max(frame_index) AS last_frame, bool_or(value >= 70) AS movement, bool_or(event_type = 'click') AS proximity FROM frames GROUP BY episode_id, pts_us // {_BIN}),
    n AS (SELECT *, lead(first_us) OVER (PARTITION BY episode_id ORDER BY bin) AS next FROM b)"""
_PROPOSALS = (
    _BINS
    + """, c AS (SELECT *, concat_ws(',', CASE WHEN movement THEN 'movement' END, CASE WHEN proximity THEN 'proximity' END) AS cues, bin % 3 <> 0 AND (movement OR proximity) AS asks FROM n WHERE next IS NOT NULL),
    u AS (SELECT *, sum(CAST(asks AS INTEGER)) OVER (PARTITION BY episode_id, bin // 10 ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM c),
    p AS (SELECT episode_id, bin, greatest(next, own) AS available_us, first_frame, last_frame, cues, CASE WHEN bin % 3 = 0 THEN 'periodic_full_scene' WHEN asks AND used <= 3 THEN 'cue_budget' WHEN asks THEN 'budget_exhausted' ELSE 'no_cue' END AS decision, bin % 3 = 0 OR (asks AND used <= 3) AS selected FROM u)"""
)
_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_BOUND = ", c AS (SELECT frame_id, count(*) AS n, max(box) AS box FROM detections WHERE class = 'A' AND score >= 0.75 GROUP BY frame_id), u AS (SELECT o_orderkey AS frame_id, CASE WHEN n = 1 THEN box END AS box, CASE WHEN n IS NULL THEN 'missing_class' WHEN n = 1 THEN 'unique_class' ELSE 'ambiguous_instances' END AS binding, o_orderstatus AS status, o_orderpriority AS priority FROM orders LEFT JOIN c ON frame_id = o_orderkey)"

ORACLE_SQL = {
    "box_geometry": sql(
        "detections",
        body=f""", w AS (SELECT *, greatest(0, floor(x1 - (x2 - x1) * 0.25)) AS a, greatest(0, floor(y1 - (y2 - y1) * 0.25)) AS b, least({WIDTH}, ceil(x2 + (x2 - x1) * 0.25)) AS c, least({HEIGHT}, ceil(y2 + (y2 - y1) * 0.25)) AS d FROM detections)
        SELECT frame_id, box, CAST(a AS BIGINT) AS w_x1, CAST(b AS BIGINT) AS w_y1, CAST(c AS BIGINT) AS w_x2, CAST(d AS BIGINT) AS w_y2, CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' ELSE 'larger' END AS size, round(x1 - a, 4) AS inner_x1 FROM w""",
    ),
    "box_violations": sql("detections", body=" SELECT frame_id, box, 'box' AS rule FROM detections WHERE NOT (x1 >= 0 AND y1 >= 0 AND x1 < x2 AND y1 < y2 AND x2 <= 500 AND y2 <= 120) UNION ALL SELECT frame_id, box, 'score' FROM detections WHERE NOT (score BETWEEN 0 AND 1)"),
    "accepted_detections": sql("detections", body=" SELECT class, count(*) AS n, min(score) AS least FROM detections WHERE score >= 0.75 GROUP BY class"),
    "nearest_neighbor_box": sql(
        "detections",
        body=""", p AS (SELECT a.frame_id, a.box, b.box AS person, round(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2, 6) AS d FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.class = 'N' AND b.class = 'R'),
        r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, box ORDER BY d, person) AS k FROM p) SELECT frame_id, box, person, d AS squared_distance FROM r WHERE k = 1""",
    ),
    "box_iou_best": sql(
        "detections",
        body=f", p AS (SELECT a.frame_id, a.box, a.class = b.class AS same, {_IOU} / ({_AREA.format('a')} + {_AREA.format('b')} - {_IOU}) AS iou FROM detections a JOIN detections b ON a.frame_id = b.frame_id AND a.box <> b.box), f AS (SELECT frame_id, box, max(iou) FILTER (same) AS m, count(*) FILTER (NOT same AND iou >= 0.5) AS w FROM p GROUP BY ALL) SELECT frame_id, box, round(coalesce(m, 0), 6) AS best_iou, coalesce(w, 0) AS wrong_class FROM detections LEFT JOIN f USING (frame_id, box)",
    ),
    "unique_binding": sql("detections", body=_BOUND + " SELECT frame_id, box, binding FROM u"),
    "stratified_recall": sql("detections", body=_BOUND + " SELECT status, priority, count(*) AS eligible, CAST(sum(CAST(binding = 'unique_class' AS INTEGER)) AS BIGINT) AS localized, round(avg(CAST(binding = 'unique_class' AS INTEGER)), 6) AS recall FROM u GROUP BY GROUPING SETS ((), (status), (priority))"),
    "frame_change": sql("chunks", body=", v AS (SELECT chunk_id, CAST(vector AS DOUBLE[]) AS v, lag(CAST(vector AS DOUBLE[])) OVER (PARTITION BY episode_id ORDER BY chunk_id) AS b FROM chunks) SELECT chunk_id, CASE WHEN b IS NOT NULL THEN round(list_avg([abs(v[i] - b[i]) for i in range(1, 65)]), 6) END AS change FROM v"),
    "causal_proposals": sql("frames", body=_PROPOSALS + " SELECT * FROM p"),
    "uniform_proposals": sql("frames", body=_BINS + " SELECT episode_id, bin, 'periodic_full_scene' AS decision, true AS selected FROM n WHERE next IS NOT NULL"),
    "bracket_coverage": sql(
        "frames",
        body=_PROPOSALS
        + f""", br AS (SELECT event_id AS bracket_id, episode_id, pts_us - {3 * HOUR_US} AS a, pts_us + {3 * HOUR_US} AS b FROM frames WHERE event_type = 'error'),
        cov AS (SELECT bracket_id, br.episode_id, coalesce(sum(greatest(0, least(b, (bin + 1) * {_BIN}) - greatest(a, bin * {_BIN}))), 0) AS covered FROM br LEFT JOIN p ON p.episode_id = br.episode_id AND selected GROUP BY ALL)
        SELECT bracket_id, episode_id, CAST(covered AS BIGINT) AS covered_us, covered = 0 AS missed FROM cov""",
    ),
}
