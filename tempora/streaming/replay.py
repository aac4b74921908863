"""Recorded tables as streams: released by their clocks, part by part, and run to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.sources.staging import new_path, stage
from tempora.streaming.automata import ROCKSDB

STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def replayed(rows: DataFrame, key: str, clock: str, cuts: list[int], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes rows in parts of rising clock, streams them a part at a time through build, and returns what came out.

    Rows are computed once, as they are staged. A part is as many files as there are shuffle partitions, dealt by key, so a key's
    rows come in order from part to part. What a key has in one micro-batch is sorted together by whoever needs an order: more cuts
    make that less. Each micro-batch writes its own folder, again the same one if it is run again, so nothing is lost or doubled.
    """
    spark = rows.sparkSession
    source, checkpoint, out = (new_path(spark, f"replay-{x}") for x in ("source", "state", "out"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(rows, "replay-rows")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows
        part = part.where(F.col(clock) >= low) if low is not None else part
        part = part.where(F.col(clock) < high) if high is not None else part
        part.repartition(files, key).sortWithinPartitions(key, clock).write.mode("append").parquet(source)
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        built = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source))
        written = built.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        written.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch-{k}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(built.schema).option("recursiveFileLookup", "true").parquet(out)


def closed_bins(frames: DataFrame, bin_us: int) -> DataFrame:
    """Counts of tumbling bins, each given once a later row has closed it: the last bin stays open. frames are streamed and have pts_us."""
    at = F.timestamp_micros("pts_us").alias("at")
    timed = frames.select("episode_id", at, "x").withWatermark("at", "0 seconds")
    return timed.groupBy(F.window("at", f"{bin_us // 1_000_000} seconds")).agg(F.count(F.lit(1)).alias("frames")).select(F.unix_micros("window.start").alias("start_us"), "frames")
