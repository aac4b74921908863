"""What the corpus operators share: whole texts, staged tables in the shared folder, bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.sources.staging import drop_path, new_path, shared_dir, stage

__all__ = ["bounded", "documents", "drop_path", "identified", "joined_by_key", "lacking", "new_path", "salted_rank", "shared_dir", "slices", "stage", "tidy", "unused", "whole_text"]

#: Bytes of text that one step of a Python operator handles at a time.
SLICE_BYTES = 1 << 20

ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Rows of a narrow table (some 100 bytes each) that may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Rows of a key from which on it is joined apart from the others.
HOT_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows; else as it is, for Spark to shuffle. df is a staged table of narrow rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with the one row that table has for their key, and n, the key's number of rows. Both are staged.

    The keys that many rows have can only be few; they go to every executor, so that their rows are not gathered in a task.
    """
    hot = table.where(F.col(n) > HOT_ROWS)
    if not hot.take(1):
        return rows.join(table, key)
    hot = bounded(hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) <= HOT_ROWS), key))


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have; Spark's names don't tell upper from lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lacking(docs: DataFrame, gone: DataFrame, match: list[tuple[Column, str]]) -> DataFrame:
    """The rows of docs, with all their columns, that no row of gone (staged and narrow) matches; null matches null. Columns may have any name."""
    names = [unused(docs, f"gone_{i}") for i in range(len(match))]
    renamed = gone.select(*[F.col(c).alias(name) for (_, c), name in zip(match, names, strict=True)])
    same = F.lit(True)
    for (own, _), name in zip(match, names, strict=True):
        same = same & own.eqNullSafe(F.col(name))
    return docs.join(bounded(renamed), same, "left_anti")


def small_batches(spark: SparkSession) -> None:
    """Makes the batches that go to Python small, unless the session has its own setting: whole texts are long, and both sides hold a batch."""
    if spark.conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, str(8 << 20))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives back to the system what it has freed: a worker lives on beside others, for tasks of other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def identified(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that no other column's name can clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes of text each; a longer text is a part of its own."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for row, length in enumerate(lengths):
        if held and held + length > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += length
    if first < batch.num_rows:
        yield batch.slice(first)


def salted_rank(df: DataFrame, group: str, order: list[str], salt: Column, rank: str) -> DataFrame:
    """A gapless rank from 0 inside each group without bringing a group to one task.

    A group's rows are dealt by `salt`; counts of (group, salt) give each salt its first rank, and rows are numbered inside
    their salt by `order`. Ranks so follow (salt, order).
    """
    dealt = df.withColumn("_salt", salt)
    counts = dealt.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_first"))
    numbered = dealt.withColumn("_rn", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order)).cast("long") - 1)
    return numbered.join(firsts, numbered[group].eqNullSafe(firsts["_g"]) & (numbered["_salt"] == firsts["_s"])).withColumn(rank, F.col("_first") + F.col("_rn")).drop("_salt", "_rn", "_g", "_s", "_first")
