"""Scores of predictions over labelled documents: the score is a document's length against 5,000 characters, at most 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import retrieval
from tempora.operators import scoring as s
from tempora.sources import views
from tempora.sources.views import sql


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    p = F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 3)
    return docs.select("doc_id", "source", "lang", p.alias("p")).join(labels, "doc_id").withColumns({"truth": F.col("quality") == 1, "known": F.col("doc_id") % 9 != 0, "split": views.split_of(F.col("doc_id"))})


def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.confusion(_labelled(spark, sf_dir), F.col("truth"), F.col("p") >= 0.5, "split")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class by quality and toxicity, and one by length."""
    return _labelled(spark, sf_dir).select((F.col("quality") * 2 + F.col("toxic")).cast("int").alias("truth"), F.least(F.lit(3), F.floor(F.col("p") * 4)).cast("int").alias("predicted"))


def confusion_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.multiclass(_classes(spark, sf_dir), "truth", "predicted", 5)


def multiclass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.multiclass_summary(confusion_multiclass(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.threshold_sweep(_labelled(spark, sf_dir).where("split = 'development'"), "p", "truth").withColumn("threshold", F.round("threshold", 6))


def threshold_sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.best_threshold(s.threshold_sweep(_labelled(spark, sf_dir).where("split = 'development'"), "p", "truth"))


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.selective(_labelled(spark, sf_dir), F.col("p"), F.col("known"), F.col("truth"), 0.5)


def abstention_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.abs(F.col("p") - 0.25).alias("gap"), F.when(F.col("p") < 0.95, F.col("quality")).otherwise(-1).alias("truth"), (F.col("p") >= 0.25).cast("int").alias("predicted"))
    return s.abstention_gap(rows.withColumn("gap", F.round("gap", 6)), "gap", "truth", "predicted")


def selection_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source that is best in documents, then in mean length, then first by name."""
    by = _labelled(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.regexp_extract(F.first("source"), "[0-9]+", 0).cast("int").alias("number"))
    return retrieval.best_candidate(by, [F.col("n"), F.col("mean"), -F.col("number")], "source")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.latency_summary(views.table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity")), "v", "l_returnflag")


def interpolated_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def seed_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of means over cases, and their spread, for each language."""
    case = _labelled(spark, sf_dir).groupBy("lang", "source").agg(F.avg("p").alias("mean"))
    return case.groupBy("lang").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_pop("mean"), 6).alias("deviation"))


def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems, one by length and one by language, over the same documents."""
    rows = _labelled(spark, sf_dir).select(((F.col("p") >= 0.5) == F.col("truth")).alias("first"), ((F.col("lang") == "en") == F.col("truth")).alias("second"))
    return rows.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def identity_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as observed tracks; errors have none, and every seventh frame isn't visible."""
    f = views.frames(spark, sf_dir).withColumns({"visible": F.col("frame_index") % 7 != 6, "track": F.when(F.col("event_type") != "error", F.col("event_type"))})
    return s.identity_counts(f, ["episode_id"], "frame_index")


def alert_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as references, clicks as candidates, paired by the number of each in its episode if they lie within five days."""
    f = views.frames(spark, sf_dir)
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("episode_id", "event_type").orderBy("frame_index"))
    n = f.withColumn("number", number)
    reference = n.where("event_type = 'purchase'").select("episode_id", "number", F.col("event_id").alias("r"), F.col("pts_us").alias("r_us"), F.when(F.col("k") % 5 != 0, F.col("value") >= 50).alias("positive"))
    candidates = n.where("event_type = 'click'").select("episode_id", "number", F.col("event_id").alias("c"), F.col("pts_us").alias("c_us"), F.when(F.col("value") >= 60, "VIOLATION").when(F.col("value") < 20, "UNKNOWN").otherwise("PASS").alias("status"))
    pairs = reference.join(candidates, ["episode_id", "number"]).where(F.abs(F.col("r_us") - F.col("c_us")) <= 432_000_000_000)
    return s.alert_accounting(reference.select(F.col("r").alias("event_id"), "positive"), candidates.select(F.col("c").alias("candidate_id"), "status"), pairs.select(F.col("r").alias("event_id"), F.col("c").alias("candidate_id")), 3_600_000_000)


QUERIES = {f.__name__: f for f in (confusion_binary, confusion_multiclass, multiclass_summary, threshold_sweep, threshold_sweep_best, risk_coverage, abstention_threshold, selection_lexicographic, latency_summary, interpolated_percentiles, seed_aggregation, paired_comparison, identity_switches, alert_accounting)}

_L = """WITH l AS (SELECT doc_id, source, lang, round(least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE), 3) AS p, quality, toxic, quality = 1 AS truth, doc_id % 9 <> 0 AS known,
    CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'development' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id))"""
_F1 = "round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1"
_COUNTS = "count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn"
_SWEEP = (
    _L
    + f""", v AS (SELECT DISTINCT p FROM l WHERE split = 'development'), t AS (SELECT (p + lag(p) OVER (ORDER BY p)) / 2 AS threshold FROM v), ts AS (SELECT threshold FROM t WHERE threshold IS NOT NULL UNION SELECT 0.0 UNION SELECT 1.0),
    c AS (SELECT threshold, {_COUNTS.replace("pred", "(p >= threshold)")} FROM ts, l WHERE split = 'development' GROUP BY threshold), f AS (SELECT *, {_F1} FROM c)"""
)
_MULTI = (
    _L
    + """, c AS (SELECT quality * 2 + toxic AS t, CAST(least(3, floor(p * 4)) AS INTEGER) AS q FROM l), g AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS class),
    n AS (SELECT class, (SELECT count(*) FROM c WHERE t = class) AS support, (SELECT count(*) FROM c WHERE t = class AND q = class) AS hits, (SELECT count(*) FROM c WHERE q = class) AS predicted FROM g),
    m AS (SELECT *, round(hits / nullif(support, 0), 6) AS recall, round(coalesce(2.0 * hits / nullif(support + predicted, 0), 0), 6) AS f1 FROM n)"""
)

ORACLE_SQL = {
    "confusion_binary": _L + f", c AS (SELECT split, {_COUNTS.replace('pred', '(p >= 0.5)')} FROM l GROUP BY split) SELECT *, {_F1} FROM c",
    "confusion_multiclass": _MULTI + " SELECT * FROM m",
    "multiclass_summary": _MULTI + " SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1_declared, round(avg(f1) FILTER (support > 0), 6) AS macro_f1_supported, round(avg(recall), 6) AS balanced_accuracy FROM m",
    "threshold_sweep": _SWEEP + " SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, macro_f1 FROM f",
    "threshold_sweep_best": _SWEEP + " SELECT round(threshold, 6) AS threshold, macro_f1 FROM f ORDER BY macro_f1 DESC, abs(threshold - 0.5), threshold LIMIT 1",
    "risk_coverage": _L
    + """, r AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 1.01])::DOUBLE AS radius), c AS (SELECT radius, count(*) AS n, count(*) FILTER (abs(p - 0.5::DOUBLE) >= radius) AS answered, count(*) FILTER (abs(p - 0.5::DOUBLE) >= radius AND known) AS known_answered,
        count(*) FILTER (abs(p - 0.5::DOUBLE) >= radius AND known AND (p >= 0.5) <> truth) AS errors, count(*) FILTER (abs(p - 0.5::DOUBLE) >= radius AND NOT known) AS false_certainty FROM r, l GROUP BY radius)
        SELECT *, round(answered / n, 6) AS coverage, round(errors / nullif(known_answered, 0), 6) AS risk FROM c""",
    "abstention_threshold": _L
    + """, g AS (SELECT round(abs(p - 0.25), 6) AS gap, CASE WHEN p < 0.95 THEN quality ELSE -1 END AS t, CAST(p >= 0.25 AS INTEGER) AS q FROM l), ts AS (SELECT DISTINCT gap AS th FROM g UNION SELECT max(gap) + 1e-6 FROM g),
        c AS (SELECT th, count(*) FILTER (gap >= th) AS answered, count(*) FILTER (gap >= th AND t >= 0) AS k, count(*) FILTER (gap >= th AND t >= 0 AND t <> q) AS e, count(*) FILTER (gap >= th AND t < 0) AS u FROM ts, g GROUP BY th)
        SELECT round(th, 6) AS gap_threshold, answered FROM c WHERE u = 0 AND coalesce(e / nullif(k, 0), 0) <= 0.2 ORDER BY answered DESC, th LIMIT 1""",
    "selection_lexicographic": _L + ", b AS (SELECT source, count(*) AS n, round(avg(p), 6) AS mean FROM l GROUP BY source) SELECT source FROM b ORDER BY n DESC, mean DESC, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) LIMIT 1",
    "latency_summary": """WITH g AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS v, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag)
        SELECT l_returnflag, n AS count, round(m, 6) AS mean, v[n // 2 + 1] AS p50, v[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1] AS p95, v[n] AS max FROM g""",
    "interpolated_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "seed_aggregation": _L + ", c AS (SELECT lang, source, avg(p) AS m FROM l GROUP BY ALL) SELECT lang, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS deviation FROM c GROUP BY lang",
    "paired_comparison": _L + ' SELECT (p >= 0.5) = truth AS "first", (lang = \'en\') = truth AS "second", count(*) AS n FROM l GROUP BY ALL',
    "identity_switches": sql(
        "frames",
        body=""", v AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS track FROM frames WHERE frame_index % 7 <> 6),
        w AS (SELECT *, last_value(track IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lag(track) OVER (PARTITION BY episode_id ORDER BY frame_index) IS NULL AS gap FROM v)
        SELECT episode_id, count(*) AS visible_rows, count(track) AS matched_rows, count(*) FILTER (track <> prev) AS id_switches, count(*) FILTER (track IS NOT NULL AND prev IS NOT NULL AND gap) AS fragmentations, round(count(track) / count(*), 6) AS visible_coverage FROM w GROUP BY episode_id""",
    ),
    "alert_accounting": sql(
        "frames",
        body=""", n AS (SELECT *, row_number() OVER (PARTITION BY episode_id, event_type ORDER BY frame_index) AS number FROM frames),
        r AS (SELECT episode_id, number, pts_us, CASE WHEN k % 5 <> 0 THEN value >= 50 END AS positive FROM n WHERE event_type = 'purchase'),
        c AS (SELECT episode_id, number, pts_us, CASE WHEN value >= 60 THEN 'VIOLATION' WHEN value < 20 THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM n WHERE event_type = 'click'),
        j AS (SELECT c.*, r.number IS NOT NULL AS matched, positive FROM c LEFT JOIN r ON r.episode_id = c.episode_id AND r.number = c.number AND abs(r.pts_us - c.pts_us) <= 432000000000),
        d AS (SELECT (SELECT count(*) FROM r) AS reference_events, count(*) AS candidates, count(*) FILTER (matched) AS matched, (SELECT count(*) FROM r WHERE positive) AS positive_events, count(*) FILTER (status = 'VIOLATION' AND matched AND positive) AS true_alerts,
            count(*) FILTER (status = 'VIOLATION' AND (NOT matched OR NOT positive)) AS false_alerts, count(*) FILTER (status = 'VIOLATION' AND matched AND positive IS NULL) AS unscorable_alerts, count(*) FILTER (status = 'UNKNOWN') AS unknowns FROM j)
        SELECT *, round(matched / reference_events, 6) AS candidate_recall, round(matched / candidates, 6) AS candidate_precision, round(true_alerts / nullif(positive_events, 0), 6) AS violation_recall, round(false_alerts * 1.0::DOUBLE, 6) AS false_alerts_per_hour, round(unknowns / candidates, 6) AS unknown_fraction FROM d""",
    ),
}
