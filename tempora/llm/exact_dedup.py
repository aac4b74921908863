"""Exact deduplication with keyed state, in DataFrame operations and Structured Streaming only.

Texts are equal when they are identical after white space (space and U+0009 to U+000D) is deleted. Each row becomes a compact
record (digest of the normalised text, doc_id, length, locator: file and row in it), staged in the shared folder. A stream over those records
keeps, on disk and without expiry, one state row for each digest: how many rows had it and which of them stays (identifier and
locator). State lives in RocksDB and its checkpoint in the shared folder, so neither memory nor an executor limits or loses
it; later documents may continue from the same checkpoint. Texts whose digest was a hit are then read again, and their full
normalised bytes are compared inside each digest; texts that share a digest without being equal are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempora.llm.common import BROADCAST_ROWS, documents, identified, joined_by_key, lacking, new_path, stage, whole_text

#: Deleted before texts are compared.
WHITE = " \t\n\x0b\x0c\r"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store reserves megabytes that it may never use
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Files of staged records that one micro-batch takes.
FILES_PER_BATCH = 512


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def sha256_digest(text: Column) -> Column:
    """The 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def best_row() -> Column:
    """Of rows, the one with the most characters, then of the smallest doc_id (null last), then the first."""
    return F.min(F.struct((-F.col("characters")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("best")


def located(docs: DataFrame) -> Column | None:
    """Where a row's content is, as struct<file, row>: the same whenever it is read. None where docs don't come from files that tell."""
    try:
        place = docs.metadataColumn("_metadata")
        where = F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias("locator")
        docs.select(where).schema  # resolved here, as not every source has these
        return where
    except AnalysisException:
        return None


def locator(docs: DataFrame) -> Column:
    """located(), or else a number that holds for one reading of docs."""
    found = located(docs)
    return F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")).alias("locator") if found is None else found


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and more columns of docs."""
    identified(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), *more)


def records(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """digest, doc_id, characters and locator of each row."""
    return texts_of(docs, locator(docs)).select(digest(normalised(F.col("text"))).alias("digest"), "doc_id", F.char_length("text").alias("characters"), "locator")


def grouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), best_row())


def keyed_state(spark: SparkSession, schema: StructType, source: str, checkpoint: str, updates: str) -> DataFrame:
    """Streams the records in `source` that `checkpoint` hasn't seen into its keyed state; returns the state: digest, n, best.

    Every micro-batch writes the state rows it has changed to its own folder under `updates`, the same ones again if it is run
    again. A row's count only grows, so the update with the largest count is the state's.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        state = grouped(spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(source), "digest")
        written = state.writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{updates}/update-{k}"))
        written.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    latest = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(updates)
    return latest.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select("digest", "s.n", "s.best")


def differing(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The digests among hits (staged: digest, and n rows that have it) that texts share without being equal, byte for byte.

    Where there are too many hits to send to all tasks, only those that very many rows have are: whole texts of one digest never meet in a task before their ends are found.
    """
    text = identified(docs).select(normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = text.join(F.broadcast(hits), "digest") if few else joined_by_key(text, hits, "digest", "n")
    ends = hit.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return ends.where("least != most").select("digest")


def decided(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    found = joined_by_key(rows, state, key, "n")
    return found.select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("best.locator")).alias("kept"), "characters", "locator")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """For each row: doc_id, digest, keep_id, group_size, kept, characters, locator.

    Of equal texts the row with the most characters stays, then the one of the smallest doc_id (null last), then the first in its
    file; of fully repeated rows, one. Null counts as the empty text, and a text of white space only equals it. A very long text is
    a row like any other. Only doc_id and text are read, so other columns may have any name. An empty table gives no row.
    """
    spark = docs.sparkSession
    source, checkpoint, updates = (new_path(spark, f"exact-{x}") for x in ("records", "state", "updates"))
    rows = records(docs, digest)
    rows.write.parquet(source)
    staged = spark.read.schema(rows.schema).parquet(source)
    if not staged.take(1):
        return decided(staged, stage(grouped(staged, "digest"), "exact-groups"), "digest")
    state = stage(keyed_state(spark, rows.schema, source, checkpoint, updates), "exact-groups")
    clashes = stage(differing(docs, state.where("n > 1").select("digest", "n"), digest), "exact-clashes")
    if not clashes.take(1):
        return decided(staged, state, "digest")
    texts = texts_of(docs, locator(docs)).select(normalised(F.col("text")).alias("bytes"), "doc_id", F.char_length("text").alias("characters"), "locator").withColumn("digest", digest(F.col("bytes")))
    apart = stage(texts.join(clashes, "digest", "left_semi"), "exact-apart")
    return decided(staged.join(clashes, "digest", "left_anti"), state, "digest").unionByName(decided(apart, stage(grouped(apart, "bytes"), "exact-bytes"), "bytes"))


def survivors(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """The rows that stay, as dedup() says, with all their columns as they are, whatever their names and types.

    Rows are told apart by their place in their file; docs that don't come from files are written to the shared folder first.
    """
    if located(docs) is None:
        docs = stage(docs, "exact-docs")
    dropped = stage(dedup(docs, digest).where("not kept").select("locator.file", "locator.row"), "exact-dropped")
    place = docs.metadataColumn("_metadata")
    return lacking(docs, dropped, [(place["file_path"], "file"), (place["row_index"], "row")])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
