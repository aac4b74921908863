"""Exact search over vectors, and the metrics of ranked intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.functions import vectors as v
from tempora.operators import intervals as iv
from tempora.operators import tiles

DIGITS = 6
#: Hits that a task holds before it hands them on.
HELD_HITS = 2_000_000


def score(vector: Column, query: Column) -> Column:
    """Cosine similarity of unit vectors, rounded so that ties are ties in any engine."""
    return F.round(v.dot(vector, query), DIGITS)


def search(chunks: DataFrame, query: list[float], k: int, split: str | None = None, space: str | None = None) -> DataFrame:
    """The k chunks nearest to a query vector; ties go to the lower chunk_id. The filters come before any vector is read."""
    if not 1 <= k <= 100:
        raise ValueError("k is from 1 to 100")
    eligible = chunks.where(F.col("split") == split) if split else chunks
    eligible = eligible.where(F.col("space_id") == space) if space else eligible
    ranked = eligible.select("chunk_id", score(F.col("vector"), F.array(*map(F.lit, query))).alias("score"))
    return ranked.orderBy(F.desc("score"), "chunk_id").limit(k)


def rounded(scores: np.ndarray) -> np.ndarray:
    """As round() does in SQL: halves go away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 10**DIGITS + 0.5) / 10**DIGITS, scores) + 0.0


def tile_hits(queries: np.ndarray, vectors: np.ndarray, absent: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, column and score of the k best columns of each query, ties to the first; where absent, the score is minus infinity."""
    scores = rounded(queries @ vectors.T)
    scores[np.isnan(scores)] = np.inf  # not a number is the largest, as in SQL
    scores[absent] = -np.inf
    k = min(k, scores.shape[1])
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    over, ties = scores > least, scores == least
    query, column = np.nonzero(over | ties & (ties.cumsum(axis=1) <= k - over.sum(axis=1, keepdims=True)))
    return query, column, scores[query, column]


def ranks(chunks: DataFrame, queries: DataFrame, k: int, *keep: str) -> DataFrame:
    """The k best chunks of each query: query_id, rank from 1, chunk_id, score. Any number of queries: blocks of them meet all chunks.

    Ids are whole numbers, and each is there once. Where either has no vector the score is null, and last.
    """
    kind = {f.name: f.dataType for f in [*queries.select("query_id").schema, *chunks.select("chunk_id").schema]}
    asked = queries.select(F.col("query_id").cast("long").alias("id"), "vector")
    met = tiles.meeting(asked, chunks.select(F.col("chunk_id").cast("long").alias("id"), "vector"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, ...]] = {}

        def out() -> pa.RecordBatch:
            query, chunk, score = (np.concatenate(c) for c in zip(*held.values(), strict=True))
            held.clear()
            scores = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
            return pa.RecordBatch.from_arrays([pa.array(query), pa.array(chunk), scores], ["query_id", "chunk_id", "score"])

        for block, left, right in tiles.pairs(batches):
            (q, q_there), (c, c_there) = tiles.matrix(left.field("vector")), tiles.matrix(right.field("vector"))
            width = max(q.shape[1], c.shape[1])
            q, c = (m if m.shape[1] else np.zeros((len(m), width)) for m in (q, c))
            q_ids, c_ids = left.field("id").to_numpy(), right.field("id").to_numpy()
            order = np.argsort(c_ids, kind="stable")
            query, column, score = tile_hits(q, c[order], ~(q_there[:, None] & c_there[order]), k)
            found = q_ids[query], c_ids[order][column], score
            if block in held:
                found = tuple(np.concatenate(x) for x in zip(held[block], found, strict=True))
                best = np.lexsort((found[1], -found[2], found[0]))
                own = found[0][best]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                found = tuple(x[best[np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)])) < k]] for x in found)
            held[block] = found
            if sum(len(h[0]) for h in held.values()) >= HELD_HITS:
                yield out()
        if held:
            yield out()

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = met.mapInArrow(run, "query_id long, chunk_id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.select(F.col("query_id").cast(kind["query_id"]).alias("query_id"), F.col("chunk_id").cast(kind["chunk_id"]).alias("chunk_id"), "score", "rank")
    return best.join(chunks.select("chunk_id", *keep), "chunk_id").select("query_id", "chunk_id", *keep, "score", "rank") if keep else best


def pooled(chunks: DataFrame, key: str) -> DataFrame:
    """The direction of the mean vector of each group."""
    cells = chunks.select(key, F.posexplode("vector").alias("place", "x"))
    means = cells.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda c: c["x"])
    return means.groupBy(key).agg(vector.alias("mean")).select(key, v.unit(F.col("mean")).alias("vector"))


def interval_metrics(hits: DataFrame, truths: DataFrame, ks: list[int], coverage: float = 0.5) -> DataFrame:
    """success, interval_recall and best_iou of each query's first k hits, for each k; null where a query has no truth.

    hits: query_id, rank, episode_id, start_us, end_us; truths: query_id, truth_id, episode_id, start_us, end_us. Touching
    intervals share nothing; the best IoU counts truths that are covered too little for a match as well.
    """
    t = truths.select("query_id", "truth_id", "episode_id", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    h = hits.where(F.col("rank") <= max(ks)).select("query_id", "rank", "episode_id", "start_us", "end_us")
    bounds = [F.col(c) for c in ("start_us", "end_us", "t_start", "t_end")]
    pairs = h.join(t, ["query_id", "episode_id"]).withColumns({"shared": iv.overlap_us(*bounds), "iou": iv.temporal_iou(*bounds)})
    matched = (F.col("shared") / (F.col("t_end") - F.col("t_start"))) >= coverage
    at_k = F.explode(F.array(*map(F.lit, ks)))
    found = pairs.withColumn("k", at_k).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count_distinct(F.when(matched, F.col("truth_id"))).alias("matched"), F.max("iou").alias("iou"))
    relevant = truths.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    asked = hits.select("query_id").unionByName(truths.select("query_id")).distinct().withColumn("k", at_k)
    rows = asked.join(relevant, "query_id", "left").join(found, ["query_id", "k"], "left")
    has = F.col("relevant").isNotNull()
    n = F.coalesce("matched", F.lit(0))
    return rows.select(
        "query_id",
        "k",
        F.coalesce("relevant", F.lit(0)).alias("relevant"),
        n.alias("matched"),
        F.when(has, (n > 0).cast("int")).alias("success"),
        F.when(has, F.round(n / F.col("relevant"), DIGITS)).alias("interval_recall"),
        F.when(has, F.round(F.coalesce("iou", F.lit(0.0)), DIGITS)).alias("best_iou"),
    )


def macro(metrics: DataFrame, *names: str) -> DataFrame:
    """Means over the queries that have a truth; the others are counted apart."""
    return metrics.agg(F.count_if(F.col("relevant") > 0).alias("positive_queries"), F.count_if(F.col("relevant") == 0).alias("unsupported_queries"), *[F.round(F.avg(n), DIGITS).alias(n) for n in names])


def shuffled(chunks: DataFrame, queries: DataFrame, repeats: int, k: int, seed: int, *keep: str) -> DataFrame:
    """A baseline: the first k chunks of as many seeded orders for each query. The order is by a digest, so any engine repeats it."""
    draws = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    mixed = chunks.crossJoin(F.broadcast(draws))  # queries times repeats rows at most
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("repeat").cast("string"), F.col("chunk_id").cast("string")).cast("binary"))
    rank = F.row_number().over(W.partitionBy("query_id", "repeat").orderBy(order, "chunk_id"))
    return mixed.select("query_id", "repeat", "chunk_id", *keep, rank.alias("rank")).where(F.col("rank") <= k)


def covered_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """For each query: whether one of the first k is relevant, and the share of the relevant time that they cover."""
    truth = relevant.select("query_id", "chunk_id", "episode_id", "start_us", "end_us")
    total = iv.union_duration(truth, "query_id", "episode_id").groupBy("query_id").agg(F.sum("covered_us").alias("relevant_us"))
    hits = ranked.where(F.col("rank") <= k).select("query_id", "chunk_id").join(truth, ["query_id", "chunk_id"])
    found = iv.union_duration(hits, "query_id", "episode_id").groupBy("query_id").agg(F.sum("covered_us").alias("hit_us"))
    rows = ranked.select("query_id").distinct().join(total, "query_id", "left").join(found, "query_id", "left")
    return rows.select("query_id", F.when(F.col("relevant_us") > 0, F.col("hit_us").isNotNull()).alias("success"), F.round(F.try_divide(F.coalesce("hit_us", F.lit(0)).cast("double"), F.col("relevant_us").cast("double")), DIGITS).alias("coverage"))


def best_candidate(candidates: DataFrame, by: list[Column], value: str) -> DataFrame:
    """The candidate that is largest in these, compared one after another; negate what should be small."""
    return candidates.agg(F.max_by(value, F.struct(*by)).alias(value))


def top_two(chunks: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Zero-shot class of each chunk and how far it is ahead of the second: ties go to the lower class."""
    of_chunk = ranks(hypotheses.select(F.col("class").alias("chunk_id"), "vector"), chunks.select(F.col("chunk_id").alias("query_id"), "vector"), 2)
    at = lambda rank, column: F.max(F.when(F.col("rank") == rank, F.col(column)))
    both = of_chunk.groupBy("query_id").agg(at(1, "chunk_id").alias("predicted"), at(1, "score").alias("_1"), at(2, "score").alias("_2"))
    return both.select(F.col("query_id").alias("chunk_id"), "predicted", F.round(F.col("_1") - F.col("_2"), DIGITS).alias("gap"))
