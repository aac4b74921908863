"""Search over embedded chunks and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import vectors as v
from tempora.operators import retrieval as r
from tempora.sources import views
from tempora.sources.views import sql

QUERY_LABELS = 3
#: search_every_rank asks for every chunk whose id this divides.
QUERY_STEP = 20
WINDOW_US = 5_000_000


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a window of time for each: five seconds, in the order of their ids."""
    start = F.floor(F.col("chunk_id") / 50) * WINDOW_US
    return views.chunks(spark, sf_dir).withColumns({"start_us": start.cast("long"), "end_us": (start + WINDOW_US).cast("long")})


def _queries(chunks: DataFrame) -> DataFrame:
    """The vectors of the first chunk of each of the first labels."""
    first = chunks.where(F.col("label") < QUERY_LABELS).groupBy("label").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return first.select(F.col("label").alias("query_id"), "vector")


def _truths(chunks: DataFrame) -> DataFrame:
    """Relevant to a query: the test chunks of its label. The last query has none."""
    t = chunks.where((F.col("split") == "test") & (F.col("label") < QUERY_LABELS - 1))
    return t.select(F.col("label").alias("query_id"), F.col("chunk_id").alias("truth_id"), "episode_id", "start_us", "end_us")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    query = chunks.where("chunk_id = 0").select("vector").first()
    return r.search(chunks, [float(x) for x in query["vector"]], 10)


def search_topk_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    query = chunks.where("chunk_id = 1").select("vector").first()
    return r.search(chunks, [float(x) for x in query["vector"]], 20, split="test")


def search_multi_query_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    return r.ranks(chunks, _queries(chunks), 10).select("query_id", "rank", "chunk_id", "score")


def search_every_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of all, for each chunk whose id QUERY_STEP divides."""
    chunks = views.chunks(spark, sf_dir)
    queries = chunks.where(F.col("chunk_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "vector")
    return r.ranks(chunks, queries, 10).select("query_id", "rank", "chunk_id", "score")


def vector_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    return c.select("chunk_id", F.round(v.norm(F.col("vector")), 5).alias("norm"), v.is_unit(F.col("vector")).alias("is_unit"))


def pooled_label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = r.pooled(views.chunks(spark, sf_dir), "label").select("label", F.posexplode("vector").alias("place", "x"))
    return cells.select("label", F.col("place").cast("long").alias("place"), F.round("x", 5).alias("x"))


def fused_pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even chunk fused with the odd one after it, where there is one."""
    c = views.chunks(spark, sf_dir)
    crop = c.where("chunk_id % 2 = 1").select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("crop"))
    both = c.where("chunk_id % 2 = 0").join(crop, "chunk_id", "left")
    return both.select("chunk_id", F.round(v.fused(F.col("vector"), F.col("crop"))[0], 5).alias("x0"), F.round(v.dot(v.fused(F.col("vector"), F.col("crop")), F.col("vector")), 5).alias("towards_full"))


def zero_shot_top2_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    return r.top_two(chunks, _queries(chunks).withColumnRenamed("query_id", "class"))


def hypothesis_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.chunks(spark, sf_dir)
    h = _queries(chunks).where("query_id < 2").groupBy().pivot("query_id", [0, 1]).agg(F.first("vector"))
    return chunks.crossJoin(F.broadcast(h)).select("chunk_id", F.round(v.margin(F.col("vector"), F.col("1"), F.col("0")), 6).alias("margin"))  # one row


def interval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    hits = r.ranks(chunks.where("split = 'test'"), _queries(chunks), 10, "episode_id", "start_us", "end_us")
    return r.interval_metrics(hits, _truths(chunks), [1, 5, 10])


def retrieval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.macro(interval_metrics_at_k(spark, sf_dir).where("k = 5"), "success", "interval_recall", "best_iou")


def retrieval_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).where("split = 'test'")
    ranked = r.ranks(chunks, _queries(_chunks(spark, sf_dir)), 5)
    relevant = chunks.where(F.col("label") < QUERY_LABELS).withColumn("query_id", F.col("label"))
    return r.covered_at(ranked, relevant, 3)


def random_rank_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean success of five random chunks, over seeded orders."""
    chunks = _chunks(spark, sf_dir).where("split = 'test'")
    mixed = r.shuffled(chunks, _queries(_chunks(spark, sf_dir)).select("query_id"), 20, 5, 42, "label")
    success = mixed.groupBy("query_id", "repeat").agg(F.max((F.col("label") == F.col("query_id")).cast("int")).alias("success"))
    return success.groupBy("query_id").agg(F.round(F.avg("success"), 6).alias("random_success_at_5"))


QUERIES = {f.__name__: f for f in (search_topk, search_topk_by_split, search_multi_query_rank, search_every_rank, vector_norm_check, pooled_label_vectors, fused_pair_vectors, zero_shot_top2_gap, hypothesis_margin, interval_metrics_at_k, retrieval_macro, retrieval_at_k, random_rank_baseline)}

_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_Q = ", queries AS (SELECT label AS query_id, min_by(vector, chunk_id) AS q FROM chunks WHERE label < 3 GROUP BY label)"
_TIMED = ", timed AS (SELECT *, (chunk_id // 50) * 5000000 AS start_us, (chunk_id // 50) * 5000000 + 5000000 AS end_us FROM chunks)"
_RANKED = _Q + _TIMED + f""", scored AS (SELECT query_id, chunk_id, episode_id, label, start_us, end_us, round({_DOT.format("vector", "q")}, 6) AS score FROM timed, queries WHERE split = 'test'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""
_METRICS = (
    _RANKED
    + """, truths AS (SELECT label AS query_id, chunk_id AS truth_id, episode_id, start_us, end_us FROM timed WHERE split = 'test' AND label < 2),
    ks AS (SELECT unnest([1, 5, 10]) AS k),
    pairs AS (SELECT k, r.query_id, truth_id, greatest(0, least(r.end_us, t.end_us) - greatest(r.start_us, t.start_us)) AS shared, t.end_us - t.start_us AS dur, r.end_us - r.start_us AS own
        FROM ks, ranked r JOIN truths t ON r.query_id = t.query_id AND r.episode_id = t.episode_id WHERE r.rank <= k),
    found AS (SELECT k, query_id, count(DISTINCT CASE WHEN shared / dur >= 0.5 THEN truth_id END) AS matched, max(shared / (dur + own - shared)) AS iou FROM pairs GROUP BY ALL),
    relevant AS (SELECT query_id, count(*) AS relevant FROM truths GROUP BY query_id),
    metrics AS (SELECT query_id, coalesce(relevant, 0) AS relevant, coalesce(matched, 0) AS matched, CASE WHEN relevant IS NOT NULL THEN CAST(coalesce(matched, 0) > 0 AS INTEGER) END AS success,
        CASE WHEN relevant IS NOT NULL THEN round(coalesce(matched, 0) / relevant, 6) END AS interval_recall, CASE WHEN relevant IS NOT NULL THEN round(coalesce(iou, 0), 6) END AS best_iou, k
        FROM queries CROSS JOIN ks LEFT JOIN relevant USING (query_id) LEFT JOIN found USING (query_id, k))"""
)

ORACLE_SQL = {
    "search_topk": sql("chunks", body=f"SELECT chunk_id, round({_DOT.format('vector', '(SELECT vector FROM chunks WHERE chunk_id = 0)')}, 6) AS score FROM chunks ORDER BY score DESC, chunk_id LIMIT 10"),
    "search_topk_by_split": sql("chunks", body=f"SELECT chunk_id, round({_DOT.format('vector', '(SELECT vector FROM chunks WHERE chunk_id = 1)')}, 6) AS score FROM chunks WHERE split = 'test' ORDER BY score DESC, chunk_id LIMIT 20"),
    "search_multi_query_rank": sql(
        "chunks", body=_Q + f", s AS (SELECT query_id, chunk_id, round({_DOT.format('vector', 'q')}, 6) AS score FROM chunks, queries), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10"
    ),
    "search_every_rank": sql(
        "chunks",
        body=f", queries AS (SELECT chunk_id AS query_id, vector AS q FROM chunks WHERE chunk_id % {QUERY_STEP} = 0), s AS (SELECT query_id, chunk_id, round({_DOT.format('vector', 'q')}, 6) AS score FROM chunks, queries), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10",
    ),
    "vector_norm_check": sql("chunks", body=f"SELECT chunk_id, round(sqrt({_DOT.format('vector', 'vector')}), 5) AS norm, abs(sqrt({_DOT.format('vector', 'vector')}) - 1) < 1e-5 AS is_unit FROM chunks"),
    "pooled_label_vectors": sql(
        "chunks",
        body=", cells AS (SELECT label, CAST(unnest(vector) AS DOUBLE) AS x, unnest(range(len(vector))) AS place FROM chunks), means AS (SELECT label, place, avg(x) AS x FROM cells GROUP BY ALL), norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM means GROUP BY label) SELECT label, place, round(x / n, 5) AS x FROM means JOIN norms USING (label)",
    ),
    "fused_pair_vectors": sql(
        "chunks",
        body=""", pairs AS (SELECT a.chunk_id, CAST(a.vector AS DOUBLE[]) AS f, coalesce(CAST(b.vector AS DOUBLE[]), [0.0::DOUBLE for _ in range(64)]) AS c FROM chunks a LEFT JOIN chunks b ON b.chunk_id = a.chunk_id + 1 WHERE a.chunk_id % 2 = 0),
        sums AS (SELECT chunk_id, f, [f[i] + c[i] for i in range(1, 65)] AS s FROM pairs)
        SELECT chunk_id, round(s[1] / sqrt(list_inner_product(s, s)), 5) AS x0, round(list_inner_product(s, f) / sqrt(list_inner_product(s, s)), 5) AS towards_full FROM sums""",
    ),
    "zero_shot_top2_gap": sql(
        "chunks",
        body=_Q + f", s AS (SELECT chunk_id, query_id, round({_DOT.format('vector', 'q')}, 6) AS score FROM chunks, queries), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, query_id) AS k FROM s) SELECT chunk_id, max(CASE WHEN k = 1 THEN query_id END) AS predicted, round(max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END), 6) AS gap FROM r GROUP BY chunk_id",
    ),
    "hypothesis_margin": sql("chunks", body=_Q + f" SELECT chunk_id, round({_DOT.format('vector', '(SELECT q FROM queries WHERE query_id = 1)')} - {_DOT.format('vector', '(SELECT q FROM queries WHERE query_id = 0)')}, 6) AS margin FROM chunks"),
    "interval_metrics_at_k": sql("chunks", body=_METRICS + " SELECT * FROM metrics"),
    "retrieval_macro": sql("chunks", body=_METRICS + " SELECT count(*) FILTER (relevant > 0) AS positive_queries, count(*) FILTER (relevant = 0) AS unsupported_queries, round(avg(success), 6) AS success, round(avg(interval_recall), 6) AS interval_recall, round(avg(best_iou), 6) AS best_iou FROM metrics WHERE k = 5"),
    "retrieval_at_k": sql(
        "chunks",
        body=_RANKED
        + """, rel AS (SELECT label AS query_id, chunk_id, episode_id, start_us, end_us FROM timed WHERE split = 'test' AND label < 3),
        own AS (SELECT *, greatest(0, end_us - greatest(start_us, coalesce(max(end_us) OVER (PARTITION BY query_id, episode_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_us))) AS o FROM rel),
        total AS (SELECT query_id, sum(o) AS t FROM own GROUP BY query_id),
        hit AS (SELECT rel.* FROM rel JOIN ranked USING (query_id, chunk_id) WHERE rank <= 3),
        hown AS (SELECT query_id, greatest(0, end_us - greatest(start_us, coalesce(max(end_us) OVER (PARTITION BY query_id, episode_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_us))) AS o FROM hit),
        found AS (SELECT query_id, sum(o) AS h FROM hown GROUP BY query_id)
        SELECT query_id, CASE WHEN t > 0 THEN h IS NOT NULL END AS success, round(CAST(coalesce(h, 0) AS DOUBLE) / nullif(t, 0), 6) AS coverage FROM queries LEFT JOIN total USING (query_id) LEFT JOIN found USING (query_id)""",
    ),
    "random_rank_baseline": sql(
        "chunks",
        body=_Q
        + """, draws AS (SELECT query_id, unnest(range(1, 21)) AS repeat FROM queries), mixed AS (SELECT query_id, repeat, label, row_number() OVER (PARTITION BY query_id, repeat ORDER BY md5('42-' || query_id || '-' || repeat || '-' || chunk_id), chunk_id) AS rank FROM chunks, draws WHERE split = 'test'),
        s AS (SELECT query_id, repeat, max(CAST(label = query_id AS INTEGER)) AS success FROM mixed WHERE rank <= 5 GROUP BY ALL) SELECT query_id, round(avg(success), 6) AS random_success_at_5 FROM s GROUP BY query_id""",
    ),
}
