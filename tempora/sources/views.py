"""The evidence tables, as views over the recorded tables. All clocks are whole microseconds; intervals are half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMMIT_DELAY_US = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column) -> Column:
    digit = F.pmod(key, F.lit(10))
    return F.when(digit < 6, "train").when(digit < 8, "development").otherwise("test")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, frame_index, pts_us and what was seen, in the order of recording; one episode for each user."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    episode = W.partitionBy("user_id")
    return events.select(
        F.col("user_id").alias("episode_id"),
        (F.row_number().over(episode.orderBy("event_id")).cast("long") - 1).alias("frame_index"),
        (at - F.min(at).over(episode)).alias("pts_us"),
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def episodes(seen: DataFrame) -> DataFrame:
    return seen.groupBy("episode_id").agg((F.max("pts_us") + 1).alias("duration_us"), F.count(F.lit(1)).alias("frames")).select(
        "episode_id", "duration_us", "frames", split_of(F.col("episode_id")).alias("split"), F.concat(F.lit("g"), F.pmod("episode_id", F.lit(10)).cast("string")).alias("split_group")
    )


def observations(seen: DataFrame) -> DataFrame:
    """Observations of the property "high", with the three clocks; an error event has no value and says why."""
    unknown = F.col("event_type") == "error"
    available = F.col("pts_us") + F.col("k") * 10_000
    return seen.select(
        F.col("event_id").alias("observation_id"),
        "episode_id",
        F.col("event_type").alias("stream_id"),
        F.when(~unknown, F.col("value") >= 50).alias("value"),
        F.when(unknown, "source_error").alias("unknown_reason"),
        F.col("pts_us").alias("event_us"),
        available.alias("available_us"),
        (available + COMMIT_DELAY_US).alias("committed_us"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks: chunk_id, episode_id, split, label and vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.pmod("vec_id", F.lit(50)).alias("episode_id"), split_of(F.col("vec_id")).alias("split"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vector")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a frame (one for each order line): corners, class and score."""
    line = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") * 10, F.col("l_linenumber").cast("double") * 20
    return line.select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").cast("int").alias("box"),
        F.col("l_returnflag").alias("class"),
        F.round(1 - F.col("l_discount") * 5, 6).alias("score"),
        x.alias("x1"),
        y.alias("y1"),
        (x + 20 + F.col("l_discount") * 1000).alias("x2"),
        (y + 20 + F.col("l_tax") * 1000).alias("y2"),
    )


#: The same views for the SQL that queries are checked against, as common table expressions.
SQL = {
    "frames": """frames AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index,
        epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS pts_us, event_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "episodes": """episodes AS (SELECT episode_id, max(pts_us) + 1 AS duration_us, count(*) AS frames,
        CASE WHEN episode_id % 10 < 6 THEN 'train' WHEN episode_id % 10 < 8 THEN 'development' ELSE 'test' END AS split,
        'g' || (episode_id % 10) AS split_group FROM frames GROUP BY episode_id)""",
    "observations": """observations AS (SELECT event_id AS observation_id, episode_id, event_type AS stream_id,
        CASE WHEN event_type <> 'error' THEN value >= 50 END AS value, CASE WHEN event_type = 'error' THEN 'source_error' END AS unknown_reason,
        pts_us AS event_us, pts_us + k * 10000 AS available_us, pts_us + k * 10000 + 250000 AS committed_us FROM frames)""",
    "chunks": """chunks AS (SELECT vec_id AS chunk_id, vec_id % 50 AS episode_id,
        CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'development' ELSE 'test' END AS split,
        CAST(label AS INTEGER) AS label, embedding AS vector FROM embeddings)""",
    "detections": """detections AS (SELECT l_orderkey AS frame_id, CAST(l_linenumber AS INTEGER) AS box, l_returnflag AS class, round(1 - l_discount * 5, 6) AS score,
        l_quantity * 10 AS x1, CAST(l_linenumber AS DOUBLE) * 20 AS y1, l_quantity * 10 + 20 + l_discount * 1000 AS x2, CAST(l_linenumber AS DOUBLE) * 20 + 20 + l_tax * 1000 AS y2 FROM lineitem)""",
}
NEEDS = {"episodes": ["frames"], "observations": ["frames"]}


def sql(*views: str, body: str) -> str:
    """A SELECT over views, which come before it as common table expressions. A body that begins with a comma brings its own."""
    wanted: list[str] = []
    for v in views:
        wanted += [n for n in [*NEEDS.get(v, []), v] if n not in wanted]
    return f"WITH {', '.join(SQL[v] for v in wanted)} {body}"
