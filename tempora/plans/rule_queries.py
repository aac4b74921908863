"""Rules over stored observations. Triggers are purchases; what they ask is whether a view at the same time was high."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import rules
from tempora.sources import views
from tempora.sources.views import sql

DAY_US = 86_400_000_000
AS_OF_US = 20 * DAY_US
HOUR_US = DAY_US // 24


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Triggers and observations. A trigger has an uncertain time if its id ends in 7; observations lie on whole days."""
    seen = views.observations(views.frames(spark, sf_dir))
    day = (F.floor(F.col("event_us") / DAY_US) * DAY_US).cast("long")
    triggers = seen.where("stream_id = 'purchase'").select(F.col("observation_id").alias("trigger_id"), "episode_id", day.alias("lo_us"), (day + F.when(F.col("observation_id") % 10 == 7, HOUR_US).otherwise(0)).alias("hi_us"), "available_us", "committed_us")
    states = seen.where("stream_id in ('view', 'error')").withColumn("event_us", day)
    return triggers, states


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers, states = _parts(spark, sf_dir)
    return rules.state_at_event(triggers, states, True, AS_OF_US, ["episode_id"])


def rule_state_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


def rule_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each episode's first signup came before its first purchase; times are known to the hour about them."""
    f = views.frames(spark, sf_dir)
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("pts_us")))
    both = f.groupBy("episode_id").agg(first("signup").alias("a"), first("purchase").alias("b"))
    pairs = both.select("episode_id", F.col("a").alias("first_lo_us"), (F.col("a") + HOUR_US * 24).alias("first_hi_us"), F.col("b").alias("second_lo_us"), (F.col("b") + HOUR_US * 24).alias("second_hi_us"))
    return rules.before(pairs).select("episode_id", "status", "reason")


def rule_no_event_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each day of an episode was free of errors; errors are known to the hour, clicks attest a day and a half about them."""
    f = views.frames(spark, sf_dir)
    clocks = {"available_us": F.col("pts_us") + F.col("k") * 10_000, "committed_us": F.col("pts_us") + F.col("k") * 10_000 + 250_000}
    spans = views.episodes(f).select("episode_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("duration_us") - 1) / DAY_US))).alias("day"))
    spans = spans.select((F.col("episode_id") * 1000 + F.col("day")).alias("span_id"), "episode_id", (F.col("day") * DAY_US).alias("start_us"), ((F.col("day") + 1) * DAY_US).alias("end_us"))
    events = f.where("event_type = 'error'").select("episode_id", F.col("pts_us").alias("lo_us"), (F.col("pts_us") + HOUR_US).alias("hi_us"), *[c.alias(n) for n, c in clocks.items()])
    cover = f.where("event_type in ('click', 'view')").select("episode_id", (F.col("pts_us") - 18 * HOUR_US).alias("start_us"), (F.col("pts_us") + 18 * HOUR_US).alias("end_us"), *[c.alias(n) for n, c in clocks.items()])
    return rules.no_event_in(spans, events, cover, AS_OF_US)


def handoff_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence is there for triggers of even id."""
    triggers, _ = _parts(spark, sf_dir)
    return rules.handoff(_decisions(spark, sf_dir), triggers.where("trigger_id % 2 = 0")).select("trigger_id", "status", "reason", "plan")


def conditioned_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same triggers with answers of clicks as a stream of its own."""
    triggers, states = _parts(spark, sf_dir)
    day = (F.floor(F.col("event_us") / DAY_US) * DAY_US).cast("long")
    answers = views.observations(views.frames(spark, sf_dir)).where("stream_id = 'click'").withColumn("event_us", day)
    return rules.reconsidered(triggers, states, answers, True, AS_OF_US, ["episode_id"])


QUERIES = {f.__name__: f for f in (rule_state_at_event, rule_before, rule_no_event_in, handoff_plan, conditioned_decisions)}

_DAYS = f", o AS (SELECT *, event_us // {DAY_US} * {DAY_US} AS day, available_us <= {AS_OF_US} AND committed_us <= {AS_OF_US} AS shown FROM observations)"


def _decided(name: str, streams: str) -> str:
    return f""", {name}_s AS (SELECT episode_id, day, count(*) AS n, count(*) FILTER (value IS NULL) AS u, bool_and(value) AS l, bool_or(value) AS m FROM o WHERE stream_id IN ({streams}) AND shown GROUP BY ALL),
    {name} AS (SELECT observation_id AS trigger_id, t.episode_id, CASE WHEN NOT shown THEN 'trigger_not_observed' WHEN observation_id % 10 = 7 THEN 'uncertain_trigger_requires_interval_evidence' WHEN n IS NULL THEN 'no_exact_state_sample' WHEN u > 0 THEN 'source_unknown'
        WHEN l <> m THEN 'disagreeing_samples' WHEN l THEN 'observed_state_match' ELSE 'observed_state_mismatch' END AS reason,
        CASE reason WHEN 'observed_state_match' THEN 'PASS' WHEN 'observed_state_mismatch' THEN 'VIOLATION' ELSE 'UNKNOWN' END AS status FROM o t LEFT JOIN {name}_s s ON s.episode_id = t.episode_id AND s.day = t.day WHERE t.stream_id = 'purchase')"""


_STATE = _DAYS + _decided("d", "'view', 'error'")

ORACLE_SQL = {
    "rule_state_at_event": sql("observations", body=_STATE + " SELECT trigger_id, episode_id, status, reason FROM d"),
    "rule_before": sql(
        "frames",
        body=f""", b AS (SELECT episode_id, min(pts_us) FILTER (event_type = 'signup') AS a, min(pts_us) FILTER (event_type = 'purchase') AS b FROM frames GROUP BY episode_id),
        s AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'UNKNOWN' WHEN a + {DAY_US} < b THEN 'PASS' WHEN a >= b + {DAY_US} THEN 'VIOLATION' ELSE 'UNKNOWN' END AS status FROM b)
        SELECT episode_id, status, CASE WHEN a IS NULL OR b IS NULL THEN 'required_event_not_observed' WHEN status = 'PASS' THEN 'strictly_before' WHEN status = 'VIOLATION' THEN 'not_strictly_before' ELSE 'overlapping_event_uncertainty' END AS reason FROM s""",
    ),
    "rule_no_event_in": sql(
        "episodes",
        body=f""", clocked AS (SELECT *, pts_us + k * 10000 + 250000 <= {AS_OF_US} AS shown FROM frames),
        spans AS (SELECT episode_id, unnest(range(0, (duration_us - 1) // {DAY_US} + 1)) AS day FROM episodes),
        s AS (SELECT episode_id * 1000 + day AS span_id, episode_id, day * {DAY_US} AS a, (day + 1) * {DAY_US} AS b FROM spans),
        e AS (SELECT span_id, max(CASE WHEN a <= pts_us AND pts_us + {HOUR_US} < b THEN 1 ELSE 0 END) AS certain FROM s JOIN clocked c ON c.episode_id = s.episode_id AND c.event_type = 'error' AND shown AND pts_us + {HOUR_US} >= a AND pts_us < b GROUP BY span_id),
        c AS (SELECT span_id, a, b, pts_us - {18 * HOUR_US} AS ca, pts_us + {18 * HOUR_US} AS cb FROM s JOIN clocked c ON c.episode_id = s.episode_id AND c.event_type IN ('click', 'view') AND shown AND pts_us - {18 * HOUR_US} < b AND a < pts_us + {18 * HOUR_US}),
        g AS (SELECT span_id, ca > coalesce(max(cb) OVER (PARTITION BY span_id ORDER BY ca, cb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS gap, cb FROM c),
        k AS (SELECT span_id, bool_or(gap) AS gap, max(cb) AS reach FROM g GROUP BY span_id),
        r AS (SELECT s.span_id, episode_id, CASE WHEN certain = 1 THEN 'prohibited_event_observed' WHEN certain = 0 THEN 'event_overlaps_interval_boundary' WHEN {AS_OF_US} < b THEN 'interval_not_finished' WHEN reach IS NULL OR gap OR reach < b THEN 'event_coverage_gap' ELSE 'covered_event_absence' END AS reason FROM s LEFT JOIN e USING (span_id) LEFT JOIN k USING (span_id))
        SELECT span_id, episode_id, CASE reason WHEN 'prohibited_event_observed' THEN 'VIOLATION' WHEN 'covered_event_absence' THEN 'PASS' ELSE 'UNKNOWN' END AS status, reason FROM r""",
    ),
    "handoff_plan": sql(
        "observations", body=_STATE + " SELECT trigger_id, status, reason, CASE WHEN status <> 'UNKNOWN' THEN 'not_needed' WHEN reason IN ('no_exact_state_sample', 'source_unknown', 'disagreeing_samples') AND trigger_id % 2 = 0 THEN 'ready' ELSE 'unavailable' END AS plan FROM d"
    ),
    "conditioned_decisions": sql("observations", body=_STATE + _decided("c", "'click'") + " SELECT trigger_id, d.status, d.reason, c.status AS conditioned_status, c.reason AS conditioned_reason FROM d JOIN c USING (trigger_id)"),
}
