"""Runs, transitions and automata over each episode's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators import sequences as sq
from tempora.sources import views
from tempora.sources.views import sql

HOUR_US = 3_600_000_000
PERSISTENCE_US, GAP_US = 6 * HOUR_US, 48 * HOUR_US
#: Steps and what must have come before them.
NEEDS = {"purchase": ["signup", "view"], "click": ["view"], "view": [], "signup": [], "error": ["click"]}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a label of 0 to 2 that errors lack."""
    f = views.frames(spark, sf_dir)
    return f.withColumn("label", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 60).cast("int")))


def valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.valid_runs(views.frames(spark, sf_dir), F.col("event_type") != "error")


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.state_runs(views.frames(spark, sf_dir), "event_type")


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.transitions(_cells(spark, sf_dir), "label", GAP_US)


def departure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.departures(views.frames(spark, sf_dir), F.col("value") >= 20)


def departure_events_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As departure_events, but anew after every long pause: each segment counts as an episode of its own."""
    cells = sq.with_resets(views.frames(spark, sf_dir), GAP_US).withColumn("episode_id", F.concat_ws("/", F.col("episode_id").cast("string"), F.col("segment").cast("string")))
    return sq.departures(cells, F.col("value") >= 20)


def hysteresis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.hysteresis(_cells(spark, sf_dir), "label", PERSISTENCE_US, GAP_US).select("event_id", "state")


def persistence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.persistence_gate(views.frames(spark, sf_dir), "value", 60.0, 30.0, 6 * HOUR_US).select("event_id", "state")


def prefix_availability_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.frames(spark, sf_dir).withColumn("available_us", F.col("pts_us") + F.col("k") * 10_000)
    return sq.causal_dependencies(cells, F.col("event_type") != "error", "event_id", "available_us")


def transition_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.range(3).select(F.col("id").cast("int").alias("class"))
    prior = sq.transition_prior(_cells(spark, sf_dir), "label", classes)
    return prior.select("before", "after", F.round("log_p", 6).alias("log_p"))


def edit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles against its roles in reverse."""
    letters = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("role", 1, 1).alias("r"))
    line = letters.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]), "").alias("roles"))
    return line.select("conv_id", F.round(sq.edit_score(F.col("roles"), F.reverse("roles")), 6).alias("score"))


def prerequisite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.out_of_order(views.frames(spark, sf_dir), NEEDS, "event_type", ["episode_id"], "frame_index").select("event_id", F.array_join("missing", ",").alias("missing"))


def prerequisite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, less sure after a pause in what was recorded."""
    f = views.frames(spark, sf_dir)
    pause = f.pts_us - F.lag("pts_us").over(W.partitionBy("episode_id").orderBy("frame_index")) > GAP_US
    f = f.withColumn("pause", F.coalesce(pause, F.lit(False)))
    return sq.out_of_order(f, NEEDS, "event_type", ["episode_id"], "frame_index", F.col("pause")).select("event_id", F.array_join("missing", ",").alias("missing"), "status")


QUERIES = {f.__name__: f for f in (valid_runs, state_runs, state_transitions, departure_events, departure_events_with_resets, hysteresis_labels, persistence_gate, prefix_availability_evidence, transition_prior, edit_score, prerequisite_order, prerequisite_status)}

_CELLS = ", cells AS (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 60) AS INTEGER) END AS label FROM frames)"
_DEPARTURES = """, r AS (SELECT *, value >= 20 AS present, row_number() OVER (PARTITION BY ep ORDER BY frame_index) - row_number() OVER (PARTITION BY ep, value >= 20 ORDER BY frame_index) AS g FROM {0}),
    i AS (SELECT ep, present, g, count(*) AS n, min(frame_index) AS first, min(pts_us) AS event_us, min(frame_index) + 2 AS confirmation FROM r GROUP BY ep, present, g),
    a AS (SELECT *, sum(CASE WHEN present AND n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM i),
    f AS (SELECT *, lag(q, 1, 0) OVER (PARTITION BY ep ORDER BY first) AS before FROM a WHERE NOT present AND n >= 3)
    SELECT f.ep AS episode_id, event_us, c.pts_us AS available_us, first, confirmation FROM f JOIN {0} c ON c.ep = f.ep AND c.frame_index = f.confirmation WHERE q > before"""

ORACLE_SQL = {
    "valid_runs": sql("frames", body=", v AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_id ORDER BY frame_index) AS g FROM frames WHERE event_type <> 'error') SELECT episode_id, min(frame_index) AS first, max(frame_index) AS last, count(*) AS length FROM v GROUP BY episode_id, g"),
    "state_runs": sql(
        "frames", body=", v AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame_index) - row_number() OVER (PARTITION BY episode_id, event_type ORDER BY frame_index) AS g FROM frames) SELECT episode_id, event_type, min(frame_index) AS first, max(frame_index) AS last, min(pts_us) AS start_us, max(pts_us) AS end_us FROM v GROUP BY episode_id, event_type, g"
    ),
    "state_transitions": sql(
        "frames", body=_CELLS + f", p AS (SELECT episode_id, lag(pts_us) OVER w AS from_us, pts_us AS to_us, lag(label) OVER w AS before, label AS after FROM cells WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)) SELECT * FROM p WHERE before <> after AND to_us - from_us <= {GAP_US}"
    ),
    "departure_events": sql("frames", body=", e AS (SELECT episode_id AS ep, * FROM frames)" + _DEPARTURES.format("e")),
    "departure_events_with_resets": sql(
        "frames", body=f", l AS (SELECT *, CASE WHEN pts_us - lag(pts_us) OVER (PARTITION BY episode_id ORDER BY frame_index) > {GAP_US} THEN 1 ELSE 0 END AS cut FROM frames), e AS (SELECT episode_id || '/' || sum(cut) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep, * FROM l)" + _DEPARTURES.format("e")
    ),
    "hysteresis_labels": sql(
        "frames",
        body=_CELLS
        + f""", m AS (SELECT *, CASE WHEN label IS NULL OR lag(label) OVER w IS NULL OR pts_us - lag(pts_us) OVER w > {GAP_US} THEN 1 ELSE 0 END AS cut FROM cells WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)),
        s AS (SELECT *, sum(cut) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM m),
        i AS (SELECT *, row_number() OVER (PARTITION BY episode_id, seg ORDER BY frame_index) - row_number() OVER (PARTITION BY episode_id, seg, label ORDER BY frame_index) AS g FROM s),
        c AS (SELECT *, CASE WHEN pts_us - min(pts_us) OVER (PARTITION BY episode_id, seg, label, g) >= {PERSISTENCE_US} THEN label END AS ok FROM i)
        SELECT event_id, CASE WHEN label IS NULL THEN -1 ELSE coalesce(last_value(ok IGNORE NULLS) OVER (PARTITION BY episode_id, seg ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) END AS state FROM c""",
    ),
    # The gate as a recursive walk from frame to frame, which is how its states are defined.
    "persistence_gate": "WITH RECURSIVE "
    + sql("frames", body="").removeprefix("WITH ")
    + f""", walk AS (
        SELECT episode_id, frame_index, event_id, CASE WHEN value >= 60 THEN pts_us END AS since, CASE WHEN value >= 60 THEN 'possible' ELSE 'normal' END AS state FROM frames WHERE frame_index = 0
        UNION ALL
        SELECT f.episode_id, f.frame_index, f.event_id,
            CASE WHEN f.value >= 60 THEN coalesce(w.since, f.pts_us) END,
            CASE WHEN f.value < 30 THEN 'normal' WHEN w.state = 'incident' THEN 'incident' WHEN f.value >= 60 AND w.since IS NOT NULL AND f.pts_us - w.since >= {6 * HOUR_US} THEN 'incident' WHEN f.value >= 60 OR w.state = 'possible' THEN 'possible' ELSE 'normal' END
        FROM walk w JOIN frames f ON f.episode_id = w.episode_id AND f.frame_index = w.frame_index + 1)
    SELECT event_id, state FROM walk""",
    "prefix_availability_evidence": sql(
        "frames",
        body=""", v AS (SELECT *, pts_us + k * 10000 AS available_us, frame_index - row_number() OVER (PARTITION BY episode_id ORDER BY frame_index) AS g FROM frames WHERE event_type <> 'error')
        SELECT episode_id, frame_index, max(available_us) OVER p AS prefix_available_us, max(available_us) OVER r AS offline_available_us, count(*) OVER p AS prefix_evidence, count(*) OVER r AS run_evidence FROM v
        WINDOW p AS (PARTITION BY episode_id, g ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY episode_id, g)""",
    ),
    "transition_prior": sql(
        "frames",
        body=_CELLS
        + """, p AS (SELECT lag(label) OVER (PARTITION BY episode_id ORDER BY frame_index) AS before, label AS after FROM cells), n AS (SELECT before, after, count(*) AS n FROM p WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL),
        g AS (SELECT CAST(a AS INTEGER) AS before, CAST(b AS INTEGER) AS after FROM range(3) x(a), range(3) y(b)), f AS (SELECT before, after, coalesce(n, 0) + 1 AS n FROM g LEFT JOIN n USING (before, after)) SELECT before, after, round(ln(n / sum(n) OVER (PARTITION BY before)), 6) AS log_p FROM f""",
    ),
    "edit_score": "WITH l AS (SELECT conv_id, string_agg(substr(role, 1, 1), '' ORDER BY turn, substr(role, 1, 1)) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, round(1 - levenshtein(r, reverse(r)) / greatest(length(r), 1), 6) AS score FROM l",
    "prerequisite_order": sql(
        "frames",
        body=""", needs AS (SELECT * FROM (VALUES ('purchase', 'signup'), ('purchase', 'view'), ('click', 'view'), ('error', 'click')) AS t(step, need)),
        firsts AS (SELECT episode_id, event_type, min(frame_index) AS first FROM frames GROUP BY ALL)
        SELECT event_id, string_agg(need, ',' ORDER BY need) AS missing FROM frames f JOIN needs ON step = f.event_type LEFT JOIN firsts x ON x.episode_id = f.episode_id AND x.event_type = need WHERE first IS NULL OR first > frame_index GROUP BY event_id""",
    ),
}

ORACLE_SQL["prerequisite_status"] = f"""WITH o AS ({ORACLE_SQL["prerequisite_order"]}), {sql("frames", body="").removeprefix("WITH ")},
    p AS (SELECT *, coalesce(pts_us - lag(pts_us) OVER (PARTITION BY episode_id ORDER BY frame_index) > {GAP_US}, false) AS pause FROM frames),
    g AS (SELECT event_id, bool_or(pause) OVER (PARTITION BY episode_id ORDER BY frame_index) AS gap FROM p) SELECT event_id, missing, CASE WHEN gap THEN 'uncertain' ELSE 'wrong_order' END AS status FROM o JOIN g USING (event_id)"""
