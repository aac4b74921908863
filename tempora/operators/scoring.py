"""Scores of predictions. Where a denominator is empty the result is null, or what the metric's own rule says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADII = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 1.01)
DIGITS = 6


def counts(truth: Column, predicted: Column) -> list[Column]:
    return [F.count_if(ok).alias(n) for n, ok in (("tp", truth & predicted), ("fp", ~truth & predicted), ("fn", truth & ~predicted), ("tn", ~truth & ~predicted))]


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 of both classes; a class without any row counts as 0."""
    f1 = lambda hit: F.coalesce(F.try_divide(2.0 * hit, 2 * hit + fp + fn), F.lit(0.0))
    return (f1(tp) + f1(tn)) / 2


def confusion(rows: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    tallied = rows.groupBy(*by).agg(*counts(truth, predicted))
    return tallied.withColumn("macro_f1", F.round(macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]), DIGITS))


def multiclass(rows: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """For each class: support, hits, predicted, recall and F1; recall is null without support, F1 then 0."""
    grid = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    t = rows.groupBy(F.col(truth).alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("hits"))
    p = rows.groupBy(F.col(predicted).alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    zero = F.lit(0).cast("long")
    full = grid.join(t, "class", "left").join(p, "class", "left").select("class", *[F.coalesce(c, zero).alias(c) for c in ("support", "hits", "predicted")])
    return full.select("*", F.round(F.try_divide(F.col("hits").cast("double"), F.col("support").cast("double")), DIGITS).alias("recall"), F.round(F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0)), DIGITS).alias("f1"))


def multiclass_summary(per_class: DataFrame) -> DataFrame:
    return per_class.agg(
        F.round(F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double")), DIGITS).alias("accuracy"),
        F.round(F.avg("f1"), DIGITS).alias("macro_f1_declared"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), DIGITS).alias("macro_f1_supported"),
        F.round(F.avg("recall"), DIGITS).alias("balanced_accuracy"),
    )


def at_or_above(by: DataFrame, value: str, sums: list[str], buckets: int = 1024) -> DataFrame:
    """Adds to rows of distinct values: above_<c>, the sum of c over rows of this value or a larger one; all_<c>; and below, the next smaller value.

    Values are dealt into buckets of equal width; sums over whole buckets are a table of at most `buckets` rows, and rows are
    summed in order inside their bucket only.
    """
    span = by.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    share = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    dealt = by.crossJoin(F.broadcast(span)).withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(share * buckets)).cast("int")).drop("_lo", "_hi")
    order = W.partitionBy(F.lit(0)).orderBy("_bucket")
    later, earlier = order.rowsBetween(1, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    whole = dealt.groupBy("_bucket").agg(F.max(value).alias("_last"), *[F.sum(c).alias(c) for c in sums])
    whole = whole.select("_bucket", F.max("_last").over(earlier).alias("_below"), *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"_later_{c}") for c in sums], *[F.sum(c).over(W.partitionBy(F.lit(0))).alias(f"all_{c}") for c in sums])
    inside = W.partitionBy("_bucket").orderBy(value)
    own = dealt.select("*", F.lag(value).over(inside).alias("_lag"), *[F.sum(c).over(inside.rowsBetween(0, W.unboundedFollowing)).alias(f"_own_{c}") for c in sums])
    both = own.join(F.broadcast(whole), "_bucket")  # at most `buckets` rows
    return both.select(value, *sums, F.coalesce("_lag", "_below").alias("below"), *[(F.col(f"_own_{c}") + F.col(f"_later_{c}")).alias(f"above_{c}") for c in sums], *[f"all_{c}" for c in sums])


def threshold_sweep(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """Counts and macro F1 of score >= threshold, for the thresholds 0, the midpoints between neighbouring scores, and 1.

    Rows are summed by score first; what lies at or above a threshold is a running sum over those, so the work grows with the
    distinct scores, not with rows times thresholds.
    """
    by_score = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    at = at_or_above(by_score, "s", ["pos", "neg"]).select(F.coalesce((F.col("s") + F.col("below")) / 2, F.lit(0.0)).alias("threshold"), F.col("above_pos").alias("tp"), F.col("above_neg").alias("fp"), F.col("all_pos").alias("p"), F.col("all_neg").alias("n"))
    top = lambda c: F.coalesce(F.sum(F.when(F.col("s") >= 1, F.col(c))), F.lit(0))
    one = by_score.agg(F.lit(1.0).alias("threshold"), top("pos").alias("tp"), top("neg").alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    both = at.unionByName(one).withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")})
    return both.select("threshold", "tp", "fp", "fn", "tn", F.round(macro_f1(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]), DIGITS).alias("macro_f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the best macro F1; of equals the one nearest to a half, then the lower."""
    order = F.struct("macro_f1", (-F.abs(F.col("threshold") - 0.5)).alias("near"), (-F.col("threshold")).alias("low"))
    return sweep.agg(F.round(F.max_by("threshold", order), DIGITS).alias("threshold"), F.max("macro_f1").alias("macro_f1"))


def selective(rows: DataFrame, score: Column, known: Column, truth: Column, threshold: float, radii=RADII) -> DataFrame:
    """For each radius about the threshold inside which no answer is given: coverage, errors, risk and unknowns answered."""
    swept = rows.select(score.alias("s"), known.alias("known"), truth.alias("truth"), F.explode(F.array(*[F.lit(r) for r in radii])).alias("radius"))
    answered = F.abs(F.col("s") - threshold) >= F.col("radius")
    valid = answered & F.col("known")
    wrong = valid & ((F.col("s") >= threshold) != F.col("truth"))
    tallied = swept.groupBy("radius").agg(F.count(F.lit(1)).alias("n"), F.count_if(answered).alias("answered"), F.count_if(valid).alias("known_answered"), F.count_if(wrong).alias("errors"), F.count_if(answered & ~F.col("known")).alias("false_certainty"))
    return tallied.withColumns({"coverage": F.round(F.try_divide(F.col("answered").cast("double"), F.col("n").cast("double")), DIGITS), "risk": F.round(F.try_divide(F.col("errors").cast("double"), F.col("known_answered").cast("double")), DIGITS)})


def abstention_gap(rows: DataFrame, gap: str, truth: str, predicted: str, most_risk: float = 0.2) -> DataFrame:
    """The gap from which on answers are given: most rows answered with at most this risk and no unknown (truth < 0) answered.

    Running sums over the distinct gaps, largest first; beyond all of them nothing is answered, which always counts as valid.
    """
    known = F.col(truth) >= 0
    by_gap = rows.groupBy(F.col(gap).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("k"), F.count_if(known & (F.col(truth) != F.col(predicted))).alias("e"), F.count_if(~known).alias("u"))
    sums = at_or_above(by_gap, "g", list("nkeu")).select("g", *[F.col(f"above_{c}").alias(c) for c in "nkeu"])
    valid = sums.where((F.coalesce(F.try_divide(F.col("e").cast("double"), F.col("k").cast("double")), F.lit(0.0)) <= most_risk) & (F.col("u") == 0))
    best = valid.agg(F.min("g").alias("g"), F.max("n").alias("answered"))
    return best.crossJoin(F.broadcast(by_gap.agg(F.max("g").alias("top")))).select(F.round(F.coalesce("g", F.col("top") + 1e-6), DIGITS).alias("gap_threshold"), F.coalesce("answered", F.lit(0)).alias("answered"))


def ordered_quantile(sorted_values: Column, index: Column) -> Column:
    return F.element_at(sorted_values, (index + 1).cast("int"))


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, p50, p95 and max; a quantile is the value at a place, never interpolated.

    Places are counted over the values' histogram, so no group is gathered in one row.
    """
    tallied = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    placed = tallied.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(whole)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    p50, p95 = F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return placed.groupBy(*by).agg(F.sum("c").alias("count"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), DIGITS).alias("mean"), at(p50).alias("p50"), at(p95).alias("p95"), F.max("v").alias("max"))


def identity_counts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Switches, fragmentations and coverage of visible rows by observed ids: visible, track (null: not matched)."""
    seen = rows.where("visible")
    at = W.partitionBy(*keys).orderBy(order)
    last = F.last("track", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, -1))
    seen = seen.withColumns({"_last": last, "_gap": F.lag("track").over(at).isNull()})
    matched = F.col("track").isNotNull()
    tallied = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("visible_rows"), F.count("track").alias("matched_rows"), F.count_if(matched & F.col("_last").isNotNull() & (F.col("_last") != F.col("track"))).alias("id_switches"), F.count_if(matched & F.col("_last").isNotNull() & F.col("_gap")).alias("fragmentations"))
    return tallied.withColumn("visible_coverage", F.round(F.col("matched_rows") / F.col("visible_rows"), DIGITS))


def alert_accounting(reference: DataFrame, decisions: DataFrame, pairs: DataFrame, observed_us: int) -> DataFrame:
    """One row of alert metrics. reference: event_id, positive (null: unknown); decisions: candidate_id, status; pairs: event_id, candidate_id.

    An alert matched to a reference whose truth is unknown is unscorable, neither right nor false.
    """
    judged = decisions.join(pairs, "candidate_id", "left").join(reference, "event_id", "left")
    alert, matched = F.col("status") == "VIOLATION", F.col("event_id").isNotNull()
    d = judged.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(matched).alias("matched"),
        F.count_if(alert & F.coalesce("positive", F.lit(False))).alias("true_alerts"),
        F.count_if(alert & matched & F.col("positive").isNull()).alias("unscorable_alerts"),
        F.count_if(alert).alias("_alerts"),
        F.count_if(F.col("status") == "UNKNOWN").alias("unknowns"),
    )
    r = reference.agg(F.count(F.lit(1)).alias("reference_events"), F.count_if("positive").alias("positive_events"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), DIGITS)
    both = d.crossJoin(F.broadcast(r)).withColumn("false_alerts", F.col("_alerts") - F.col("true_alerts") - F.col("unscorable_alerts"))  # one row each
    return both.select("reference_events", "candidates", "matched", "positive_events", "true_alerts", "false_alerts", "unscorable_alerts", "unknowns", ratio("matched", "reference_events").alias("candidate_recall"), ratio("matched", "candidates").alias("candidate_precision"), ratio("true_alerts", "positive_events").alias("violation_recall"), F.round(F.col("false_alerts") * 3.6e9 / observed_us, DIGITS).alias("false_alerts_per_hour"), ratio("unknowns", "candidates").alias("unknown_fraction"))
