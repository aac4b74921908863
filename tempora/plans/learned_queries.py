"""Fitted heads, decoders, matching, admission and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators import admission
from tempora.operators import learning as ln
from tempora.operators import scans
from tempora.operators import sequences as sq
from tempora.plans import corpus_queries as corpus
from tempora.plans import sequence_queries as known
from tempora.plans import window_queries as windows
from tempora.sources import views
from tempora.sources.views import sql
from tempora.streaming import automata, replay

DAY_US = 86_400_000_000
CLASSES = 10
STATES = 3
STAY = np.log(np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]))
START = np.log(np.full(STATES, 1 / STATES))


def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on train chunks; every chunk is scored."""
    chunks = views.chunks(spark, sf_dir)
    model = ln.fit_ridge(chunks.where("split = 'train'"), "vector", "label", CLASSES)
    return ln.ridge_scores(chunks, model, "vector", "chunk_id", "split", "label")


def platt_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by length, calibrated on the development split."""
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("score")).join(views.table(spark, sf_dir, "labels"), "doc_id").withColumn("truth", F.col("quality") == 1)
    model = ln.fit_platt(rows.where(views.split_of(F.col("doc_id")) == "development"), "score", "truth")
    return rows.select("doc_id", F.round(ln.platt(F.col("score"), model), 6).alias("probability"))


def _emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three states for each frame that isn't an error, by how near its value is to each state's; runs end at errors."""
    f = views.frames(spark, sf_dir)
    at = W.partitionBy("episode_id").orderBy("frame_index")
    f = f.withColumn("valid", F.col("event_type") != "error")
    f = sq.numbered_runs(f, F.coalesce(F.lag("valid").over(at) != F.col("valid"), F.lit(True)), ["episode_id"], "frame_index").where("valid")
    return f.withColumn("scores", F.array(*[-F.pow((F.col("value") - c) / 40, 2) for c in (20.0, 60.0, 120.0)])).select("episode_id", "run", "frame_index", "event_id", "pts_us", "scores")


def _decoded(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    cells = _emissions(spark, sf_dir)
    return ln.decode_runs(cells.select("episode_id", "run", "frame_index", "scores"), ["episode_id", "run"], "scores", "frame_index", method, STAY, START)


def hmm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "filter")


def hmm_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "smooth")


def hmm_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "viterbi")


def hsmm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "segments")


def event_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases matched with clicks within a day."""
    f = views.frames(spark, sf_dir).select("episode_id", "event_id", F.col("pts_us").alias("event_us"), "event_type")
    return ln.match_events(f.where("event_type = 'purchase'"), f.where("event_type = 'click'"), DAY_US)


def greedy_segment_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viterbi states against the nearest state of each frame; a cell lasts until the next frame."""
    cells = _emissions(spark, sf_dir)
    nearest = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    end = F.lead("pts_us").over(W.partitionBy("episode_id").orderBy("frame_index"))
    truth = cells.select("episode_id", "run", "frame_index", nearest.alias("truth"), F.col("pts_us").alias("start_us"), F.coalesce(end, F.col("pts_us") + 1).alias("end_us"), F.lit(True).alias("valid"))
    both = truth.join(hmm_viterbi(spark, sf_dir), ["episode_id", "run", "frame_index"])
    return ln.segment_f1(both.select("episode_id", "start_us", "end_us", "valid", F.col("state").alias("predicted"), "truth"), "predicted", "truth")


def admission_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as jobs of a run for each episode: purchases are mandatory."""
    f = views.frames(spark, sf_dir)
    jobs = f.select("episode_id", F.col("event_id").alias("job_id"), F.col("pts_us").alias("offered_us"), (F.col("k") + 1).alias("input_bytes"), (F.col("event_type") == "purchase").alias("mandatory"))
    return admission.admission_facts(jobs, "episode_id", DAY_US, max_jobs=3, max_bytes=150)


def stream_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).select("episode_id", "frame_index", "pts_us", (F.col("value") >= 20).alias("x"))
    return replay.replayed(f, "episode_id", "pts_us", [8 * DAY_US, 16 * DAY_US], lambda s: automata.apply(s, automata.Departures(3, 3, None)))


def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = known._cells(spark, sf_dir).select("episode_id", "frame_index", "pts_us", F.col("label").alias("x"))
    return replay.replayed(f, "episode_id", "pts_us", [8 * DAY_US, 16 * DAY_US], lambda s: automata.apply(s, automata.Hysteresis(known.PERSISTENCE_US, known.GAP_US)))


def stream_closed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).select("episode_id", "pts_us", F.lit(1).alias("x"))
    return replay.replayed(f, "episode_id", "pts_us", [8 * DAY_US, 16 * DAY_US], lambda s: replay.closed_bins(s, windows.DAY_US))


def stream_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal network over cells that arrive up to days late: what causal_convolution says of them, and when."""
    cells = corpus.network_cells(spark, sf_dir).withColumnRenamed("available_us", "pts_us")
    return replay.replayed(cells, "episode_id", "pts_us", [4 * DAY_US, 8 * DAY_US, 16 * DAY_US], lambda s: automata.apply(s, automata.Predictions(corpus.NETWORK)))


def stream_released_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the predictions of stream_predictions are given."""
    return stream_predictions(spark, sf_dir).select("episode_id", "frame_index", "released_us")


QUERIES = {f.__name__: f for f in (stream_predictions, stream_released_cells, ridge_scores, platt_calibrated, hmm_filter, hmm_smooth, hmm_viterbi, hsmm_segments, event_matching, greedy_segment_f1, admission_facts, stream_departure, stream_hysteresis, stream_closed_bins)}

#: The decoders' recursions, a row of every run at a time. Viterbi weights are whole numbers, as in operators.scans.
_CENTRES = (20.0, 60.0, 120.0)
_RUNS = """, marked AS (SELECT *, event_type <> 'error' AS valid FROM frames),
        cuts AS (SELECT *, CASE WHEN lag(valid) OVER w IS NOT DISTINCT FROM valid THEN 0 ELSE 1 END AS cut FROM marked WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)),
        runs AS (SELECT *, sum(cut) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM cuts)"""


def _cells_sql(weight: str) -> str:
    scores = ", ".join(f"{weight.format(f'-pow((value - {c}) / 40, 2)')} AS e{k}" for k, c in enumerate(_CENTRES))
    return f"{_RUNS}, cells AS MATERIALIZED (SELECT episode_id, run, frame_index, row_number() OVER w AS t, count(*) OVER (PARTITION BY episode_id, run) AS n, {scores} FROM runs WHERE valid WINDOW w AS (PARTITION BY episode_id, run ORDER BY frame_index))"


def _recursive(body: str) -> str:
    return sql("frames", body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def _step(j: int, k: int) -> float:
    return float(STAY[j, k])


def _viterbi_sql() -> str:
    to = lambda x: int(np.rint(x * scans.UNIT))
    options = [[f"v.v{j} + ({to(STAY[j, k])})" for j in range(STATES)] for k in range(STATES)]
    lowest = lambda o: f"CASE WHEN {o[0]} >= greatest({o[1]}, {o[2]}) THEN 0 WHEN {o[1]} >= {o[2]} THEN 1 ELSE 2 END"
    own = ["v.v0", "v.v1", "v.v2"]
    forward = ", ".join(f"c.e{k} + greatest({', '.join(options[k])})" for k in range(STATES)) + ", " + ", ".join(lowest(options[k]) for k in range(STATES))
    start = ", ".join(f"e{k} + ({to(START[k])}) AS v{k}" for k in range(STATES)) + ", " + ", ".join(f"0 AS b{k}" for k in range(STATES))
    return _recursive(
        _cells_sql(f"round({{}} * {scans.UNIT})::BIGINT")
        + f""", v AS (SELECT episode_id, run, frame_index, t, n, {start} FROM cells WHERE t = 1 UNION ALL
        SELECT c.episode_id, c.run, c.frame_index, c.t, c.n, {forward} FROM v JOIN cells c ON c.episode_id = v.episode_id AND c.run = v.run AND c.t = v.t + 1),
        back AS (SELECT episode_id, run, frame_index, t, {lowest(own)} AS state, CASE {lowest(own)} WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS came FROM v WHERE t = n UNION ALL
        SELECT v.episode_id, v.run, v.frame_index, v.t, b.came, CASE b.came WHEN 0 THEN v.b0 WHEN 1 THEN v.b1 ELSE v.b2 END FROM back b JOIN v ON v.episode_id = b.episode_id AND v.run = b.run AND v.t = b.t - 1)
        SELECT episode_id, run, frame_index, state::INTEGER AS state FROM back"""
    )


def _likely_sql(smooth: bool) -> str:
    """v: log weights of the states so far, made to add up to one; w: of what follows."""
    total = "ln(exp({0}) + exp({1}) + exp({2}))"
    plain = lambda t, *x: t.format(*x)
    first = [f"e{k} + ({float(START[k])})" for k in range(STATES)]
    ahead = [f"c.e{k} + {plain(total, *[f'v.v{j} + ({_step(j, k)})' for j in range(STATES)])}" for k in range(STATES)]
    scaled = lambda xs: ", ".join(f"{x} - {plain(total, *xs)}" for x in xs)
    named = ", ".join(f"{x} - {plain(total, *first)} AS v{k}" for k, x in enumerate(first))
    v = f""", v AS (SELECT episode_id, run, frame_index, t, n, {named} FROM cells WHERE t = 1 UNION ALL
        SELECT c.episode_id, c.run, c.frame_index, c.t, c.n, {scaled(ahead)} FROM v JOIN cells c ON c.episode_id = v.episode_id AND c.run = v.run AND c.t = v.t + 1)"""
    after = [plain(total, *[f"({_step(j, k)}) + c.e{k} + w.w{k}" for k in range(STATES)]) for j in range(STATES)]
    w = f""", w AS (SELECT episode_id, run, t, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM cells WHERE t = n UNION ALL
        SELECT c.episode_id, c.run, c.t - 1, {scaled(after)} FROM w JOIN cells c ON c.episode_id = w.episode_id AND c.run = w.run AND c.t = w.t WHERE c.t > 1)"""
    joint = [f"v{k} + w{k}" for k in range(STATES)] if smooth else [f"v{k}" for k in range(STATES)]
    shares = ", ".join(f"round(exp({x} - {plain(total, *joint)}), {scans.DIGITS}) AS p{k}" for k, x in enumerate(joint))
    rows = "v JOIN w USING (episode_id, run, t)" if smooth else "v"
    return _recursive(_cells_sql("({})") + v + (w if smooth else "") + f", p AS (SELECT episode_id, run, frame_index, {shares} FROM {rows}) SELECT episode_id, run, frame_index, CASE WHEN p0 >= greatest(p1, p2) THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS state FROM p")


ORACLE_SQL = {
    "stream_released_cells": sql("frames", body=f" SELECT episode_id, frame_index, max(pts_us + k * {corpus.HOUR_US}) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS released_us FROM frames"),
    "hmm_viterbi": _viterbi_sql(),
    "hmm_filter": _likely_sql(False),
    "hmm_smooth": _likely_sql(True),
    "admission_facts": sql(
        "frames",
        body=f""", j AS (SELECT episode_id, event_id AS job_id, pts_us, k + 1 AS b, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS m FROM frames),
        o AS (SELECT *, count(*) OVER w - 1 AS open_jobs, CAST(sum(b) OVER w AS BIGINT) - b AS open_bytes, CAST(sum(m) OVER w AS BIGINT) - m AS mandatory_jobs, CAST(sum(b * m) OVER w AS BIGINT) - b * m AS mandatory_bytes FROM j
            WINDOW w AS (PARTITION BY episode_id ORDER BY pts_us RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW))
        SELECT episode_id, job_id, open_jobs, open_bytes, mandatory_jobs, mandatory_bytes, CASE WHEN open_jobs < 3 AND open_bytes + b <= 150 THEN 'admitted' WHEN m = 1 AND mandatory_jobs < 3 AND mandatory_bytes + b <= 150 THEN 'by_eviction' ELSE 'refused' END AS verdict FROM o""",
    ),
    "stream_departure": known.ORACLE_SQL["departure_events"],
    "stream_hysteresis": known.ORACLE_SQL["hysteresis_labels"].replace("SELECT event_id, CASE WHEN label IS NULL", "SELECT episode_id, frame_index, CASE WHEN label IS NULL"),
    "stream_closed_bins": sql("frames", body=f", b AS (SELECT pts_us // {DAY_US} AS b, count(*) AS frames FROM frames GROUP BY 1) SELECT b * {DAY_US} AS start_us, frames FROM b WHERE (b + 1) * {DAY_US} <= (SELECT max(pts_us) FROM frames)"),
}
