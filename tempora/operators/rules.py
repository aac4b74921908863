"""Three-valued rules over as-of evidence: PASS, VIOLATION or UNKNOWN, and why. What wasn't observed is never filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators.asof import visible

#: Why a point-state rule may be handed on to an investigation.
POINT_REASONS = ("no_exact_state_sample", "source_unknown", "disagreeing_samples")


def state_at_event(triggers: DataFrame, observations: DataFrame, expected: bool, as_of_us: int, keys: list[str]) -> DataFrame:
    """Whether the state at each trigger's exact time was the expected one.

    triggers: trigger_id, keys, lo_us, hi_us and the clocks available_us, committed_us. The first reason that holds is given.
    """
    shown = visible(as_of_us)
    t = triggers.select("trigger_id", *keys, "lo_us", "hi_us", shown.alias("_shown"))
    o = observations.where(shown).select(*keys, F.col("event_us").alias("lo_us"), "value")
    found = t.join(o.withColumn("_hit", F.lit(1)), [*keys, "lo_us"], "left").groupBy("trigger_id", *keys, "lo_us", "hi_us", "_shown")
    found = found.agg(F.count("_hit").alias("_n"), F.count_if(F.col("_hit").isNotNull() & F.col("value").isNull()).alias("_unknown"), F.min("value").alias("_least"), F.max("value").alias("_most"))
    reason = F.when(~F.col("_shown"), "trigger_not_observed").when(F.col("lo_us") != F.col("hi_us"), "uncertain_trigger_requires_interval_evidence").when(F.col("_n") == 0, POINT_REASONS[0]).when(F.col("_unknown") > 0, POINT_REASONS[1]).when(F.col("_least") != F.col("_most"), POINT_REASONS[2])
    decided = found.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "UNKNOWN").when(F.col("_least") == expected, "PASS").otherwise("VIOLATION")
    observed = F.when(F.col("_least") == expected, "observed_state_match").otherwise("observed_state_mismatch")
    return decided.select("trigger_id", *keys, status.alias("status"), F.coalesce("reason", observed).alias("reason"))


def before(pairs: DataFrame) -> DataFrame:
    """Whether the first event came before the second, each known within [lo, hi]: first_lo_us, first_hi_us, second_lo_us, second_hi_us."""
    missing = F.col("first_hi_us").isNull() | F.col("second_lo_us").isNull()
    status = F.when(missing, "UNKNOWN").when(F.col("first_hi_us") < F.col("second_lo_us"), "PASS").when(F.col("first_lo_us") >= F.col("second_hi_us"), "VIOLATION").otherwise("UNKNOWN")
    reason = F.when(missing, "required_event_not_observed").when(status == "PASS", "strictly_before").when(status == "VIOLATION", "not_strictly_before").otherwise("overlapping_event_uncertainty")
    return pairs.withColumns({"status": status, "reason": reason})


def no_event_in(spans: DataFrame, events: DataFrame, coverage: DataFrame, as_of_us: int) -> DataFrame:
    """Whether nothing happened in each span [start, end) of an episode; absence counts only where coverage has no gap.

    spans: span_id, episode_id, start_us, end_us; events: lo_us, hi_us and clocks; coverage: start_us, end_us and clocks.
    """
    shown = visible(as_of_us)
    s = spans.select("span_id", "episode_id", "start_us", "end_us")
    e = events.where(shown).select("episode_id", "lo_us", "hi_us")
    hits = s.join(e, "episode_id").where((F.col("hi_us") >= F.col("start_us")) & (F.col("lo_us") < F.col("end_us")))
    certain = (F.col("start_us") <= F.col("lo_us")) & (F.col("hi_us") < F.col("end_us"))
    touched = hits.groupBy("span_id").agg(F.max(certain.cast("int")).alias("_certain"))
    c = coverage.where(shown).select("episode_id", F.col("start_us").alias("c_start"), F.col("end_us").alias("c_end"))
    inside = s.join(c, "episode_id").where((F.col("c_start") < F.col("end_us")) & (F.col("start_us") < F.col("c_end")))
    reach = F.max("c_end").over(W.partitionBy("span_id").orderBy("c_start", "c_end").rowsBetween(W.unboundedPreceding, -1))
    inside = inside.withColumn("_gap", F.col("c_start") > F.coalesce(reach, F.col("start_us")))
    covered = inside.groupBy("span_id").agg(F.max(F.col("_gap").cast("int")).alias("_gap"), F.max("c_end").alias("_reach"))
    rows = s.join(touched, "span_id", "left").join(covered, "span_id", "left")
    reason = (
        F.when(F.col("_certain") == 1, "prohibited_event_observed")
        .when(F.col("_certain") == 0, "event_overlaps_interval_boundary")
        .when(F.lit(as_of_us) < F.col("end_us"), "interval_not_finished")
        .when(F.col("_reach").isNull() | (F.col("_gap") == 1) | (F.col("_reach") < F.col("end_us")), "event_coverage_gap")
        .otherwise("covered_event_absence")
    )
    decided = rows.withColumn("reason", reason)
    status = F.when(F.col("reason") == "prohibited_event_observed", "VIOLATION").when(F.col("reason") == "covered_event_absence", "PASS").otherwise("UNKNOWN")
    return decided.select("span_id", "episode_id", status.alias("status"), "reason")


def handoff(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """What to do about each decision: not_needed if it is known, ready if a look at the evidence may settle it, else unavailable."""
    has = evidence.select("trigger_id").distinct().withColumn("_has", F.lit(True))
    plan = F.when(F.col("status") != "UNKNOWN", "not_needed").when(F.col("reason").isin(*POINT_REASONS) & F.col("_has"), "ready").otherwise("unavailable")
    return decisions.join(has, "trigger_id", "left").withColumn("plan", plan).drop("_has")


def reconsidered(triggers: DataFrame, observations: DataFrame, answers: DataFrame, expected: bool, as_of_us: int, keys: list[str]) -> DataFrame:
    """The baseline decision beside one that takes answers (keys, event_us, value and clocks) as a stream of its own; neither changes the other."""
    baseline = state_at_event(triggers, observations, expected, as_of_us, keys).select("trigger_id", "status", "reason")
    conditioned = state_at_event(triggers, answers, expected, as_of_us, keys).select("trigger_id", F.col("status").alias("conditioned_status"), F.col("reason").alias("conditioned_reason"))
    return baseline.join(conditioned, "trigger_id")


def investigated(triggers: DataFrame, observations: DataFrame, answers: DataFrame, evidence: DataFrame, expected: bool, as_of_us: int, keys: list[str]) -> DataFrame:
    """The whole way of a trigger: its decision, the plan for it, and the decision that the answers of those that are ready give.

    trigger_id, status, reason, plan, conditioned_status (null where nothing was asked). Answers are a stream of their own.
    """
    planned = handoff(state_at_event(triggers, observations, expected, as_of_us, keys), evidence).select("trigger_id", "status", "reason", "plan")
    asked = triggers.join(planned.where("plan = 'ready'").select("trigger_id"), "trigger_id", "left_semi")
    given = state_at_event(asked, answers, expected, as_of_us, keys).select("trigger_id", F.col("status").alias("conditioned_status"))
    return planned.join(given, "trigger_id", "left")
