"""Append-only stores under three clocks: event <= available <= committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators.checks import require_none

CLOCKS = ("event_us", "available_us", "committed_us")


def visible(as_of: Column | int) -> Column:
    """What could be known at as_of: available and committed by then."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    return (F.col("available_us") <= as_of) & (F.col("committed_us") <= as_of)


def snapshot(observations: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """For each question (keys, event_us, as_of_us): value and status of what was observed at exactly that time and visible then.

    Status: supported, or no_visible_sample, source_unknown, disagreeing_samples, the first that holds. Nothing is carried over
    from another time.
    """
    own = observations.select(*keys, "event_us", "value", "available_us", "committed_us")
    seen = asked.join(own, [*keys, "event_us"], "left").withColumn("_seen", visible(F.col("as_of_us")))
    answer = seen.groupBy(*keys, "event_us", "as_of_us").agg(
        F.count_if("_seen").alias("_n"),
        F.count_if(F.col("_seen") & F.col("value").isNull()).alias("_unknown"),
        F.min(F.when(F.col("_seen"), F.col("value"))).alias("_least"),
        F.max(F.when(F.col("_seen"), F.col("value"))).alias("_most"),
    )
    status = F.when(F.col("_n") == 0, "no_visible_sample").when(F.col("_unknown") > 0, "source_unknown").when(F.col("_least") != F.col("_most"), "disagreeing_samples").otherwise("supported")
    answer = answer.withColumn("status", status)
    return answer.select(*keys, "event_us", "as_of_us", F.when(F.col("status") == "supported", F.col("_least")).alias("value"), "status")


def log_page(records: DataFrame, as_of_us: int, after: int, limit: int, horizon_us: int | None = None) -> DataFrame:
    """The next records of a log after a cursor, as known at as_of_us. Records are numbered by availability, then by id."""
    if horizon_us is not None and as_of_us > horizon_us:
        raise ValueError("as_of is beyond the log's horizon")
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 records")
    return records.where((F.col("seq") > after) & (F.col("available_us") <= as_of_us)).orderBy("seq").limit(limit)


def log_pages(records: DataFrame, as_of_us: int, after: int, limit: int, key: str) -> DataFrame:
    """The page that log_page gives, of every log at once."""
    known = records.where((F.col("seq") > after) & (F.col("available_us") <= as_of_us))
    place = F.row_number().over(W.partitionBy(key).orderBy("seq"))
    return known.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def sequenced(records: DataFrame, key: str) -> DataFrame:
    """seq from 1: the place of each record in its log."""
    return records.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy("available_us", "observation_id")))


def appended(store: DataFrame, incoming: DataFrame, content: list[str], identity: str = "observation_id", stream: str = "stream_id", producer: str | None = None) -> DataFrame:
    """The rows of incoming that the store lacks, after its guards have passed.

    Rows already there are left out; the same id with other content, commits before the store's latest, and a second producer
    for a stream raise.
    """
    digest = lambda df: df.select(identity, F.xxhash64(*content).alias("_content"))
    both = digest(store).withColumnRenamed("_content", "_stored").join(digest(incoming), identity)
    require_none(both.where(F.col("_stored") != F.col("_content")), "changed content under a known id")
    fresh = incoming.join(store.select(identity), identity, "left_anti")
    latest = store.agg(F.max("committed_us").alias("_latest"))  # one row
    require_none(fresh.join(F.broadcast(latest), F.col("committed_us") < F.col("_latest")), "a commit before the store's latest")
    if producer:
        used = store.select(stream, producer).unionByName(fresh.select(stream, producer)).groupBy(stream).agg(F.count_distinct(producer).alias("n"))
        require_none(used.where("n > 1"), "a second producer for a stream")
    return fresh
