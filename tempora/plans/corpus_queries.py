"""Plans, sessions, tracks, packets and the causal convolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators import convolution, corpus, packets, tracking
from tempora.sources import views
from tempora.sources.views import sql

DAY_US = 86_400_000_000
HOUR_US = DAY_US // 24


def corpus_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (views.table(spark, sf_dir, t) for t in ("nation", "region"))
    variants = spark.createDataFrame([("left",), ("right",)], "variant string")
    return corpus.planned(nation.select(F.col("n_name").alias("group")), region.select(F.col("r_name").alias("family")), variants, "plan-v1")


def tracking_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).withColumn("cut", F.col("event_type") == "signup")
    return tracking.sessions(f, 8 * HOUR_US).select("event_id", "shot")


def released_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).withColumn("available_us", F.col("pts_us") + F.col("k") * HOUR_US)
    return convolution.released_at(f).select("event_id", "released_us")


def packet_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each order with its lines as evidence, at most four images and 1,500 pixels each."""
    orders = views.table(spark, sf_dir, "orders")
    line = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity")).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence_id"), F.col("l_orderkey").alias("episode_id"), (F.col("l_linenumber") * 10).cast("long").alias("pts_us"), (F.col("l_linenumber") * 11).cast("long").alias("available_us"), F.col("l_quantity").cast("long").alias("width"), F.lit(40).cast("long").alias("height"))
    cited = line.groupBy(F.col("episode_id").alias("o")).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    p = orders.join(cited, F.col("o_orderkey") == F.col("o")).select(F.col("o_orderkey").alias("packet_id"), F.col("o_orderkey").alias("episode_id"), F.lit(10).cast("long").alias("start_us"), F.lit(61).cast("long").alias("end_us"), F.lit(60).cast("long").alias("available_us"), "evidence_ids", F.lit(4).alias("max_images"), F.lit(6000).cast("long").alias("max_pixels"))
    return packets.packet_violations(p, line, 66)


#: Frames of the orders' clock lie so far apart, and orders further apart than so many days are of two shots.
FRAME_US, SHOT_DAYS = 100_000, 200


def track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as frames of an episode, in the order of their dates; a long time without one is a cut. Half of the lines are unsure boxes or none."""
    orders = views.table(spark, sf_dir, "orders").withColumn("day", F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")))
    at = W.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    o = orders.select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("episode_id"), (F.row_number().over(at) * FRAME_US).cast("long").alias("pts_us"), (F.col("day") - F.lag("day").over(at) > SHOT_DAYS).alias("cut"))
    boxes = views.detections(spark, sf_dir).withColumn("score", F.round(1 - 1.9 * (1 - F.col("score")), 6))
    return tracking.track(boxes, tracking.sessions(o, FRAME_US), FRAME_US, 640, 480)


NETWORK = convolution.Network.random(2, 3)


def network_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as cells of two features, each available some hours late; an error's aren't valid."""
    features = F.array((F.col("value") / 100).cast("double"), (F.col("k") / 100).cast("double")).alias("features")
    return views.frames(spark, sf_dir).select("episode_id", "frame_index", (F.col("pts_us") + F.col("k") * HOUR_US).alias("available_us"), features, (F.col("event_type") != "error").alias("valid"))


def causal_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convolution.predict(network_cells(spark, sf_dir), NETWORK, "features", "valid")


def network_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against three ranges of values, the middle one of half the weight."""
    truth = F.when(F.col("features")[0] < 0.4, 0).when(F.col("features")[0] < 0.9, 1).otherwise(2)
    return convolution.loss(network_cells(spark, sf_dir).withColumn("truth", truth), NETWORK, "features", "valid", "truth", 0.15, 4.0, [1.0, 0.5, 1.0])


QUERIES = {f.__name__: f for f in (corpus_plan, tracking_sessions, released_cells, packet_violations, track_boxes, causal_convolution, network_loss)}

ORACLE_SQL = {
    "corpus_plan": """SELECT 'ep-' || substr(sha256('{"family":"' || r_name || '","group":"' || n_name || '","name":"plan-v1","variant":"' || variant || '"}'), 1, 16) AS episode_id, n_name AS "group", r_name AS family, variant FROM nation, region, (VALUES ('left'), ('right')) v(variant)""",
    "tracking_sessions": sql(
        "frames", body=f", c AS (SELECT *, CASE WHEN event_type = 'signup' OR pts_us - lag(pts_us) OVER w > {12 * HOUR_US} THEN 1 ELSE 0 END AS cut FROM frames WINDOW w AS (PARTITION BY episode_id ORDER BY pts_us)) SELECT event_id, CAST(sum(cut) OVER (PARTITION BY episode_id ORDER BY pts_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS shot FROM c"
    ),
    "released_cells": sql("frames", body=f" SELECT event_id, max(pts_us + k * {HOUR_US}) OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS released_us FROM frames"),
    "packet_violations": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey AS packet_id, count(*) AS n, sum(q * 40) AS px, max(l_linenumber) AS last FROM l GROUP BY l_orderkey)
        SELECT packet_id, 'image_budget' AS rule FROM p WHERE n > 4 UNION ALL SELECT packet_id, 'pixel_budget' FROM p WHERE px > 6000 UNION ALL SELECT packet_id, 'future_or_outside' FROM p WHERE last * 10 >= 61 OR last * 11 > 66""",
}
