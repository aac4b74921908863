"""Tables written to the folder that driver and executors share, and read back: neither recomputed nor tied to an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, a folder of our own if all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_release)
    _staged.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged_so_far() -> int:
    return len(_staged)


def drop_since(spark: SparkSession, count: int, keep: str | None = None) -> None:
    """Drops what has been staged since staged_so_far() said count, but for one path; nothing may read it any more."""
    later = [x for x in _staged[count:] if x[1] != keep]
    _staged[count:] = [x for x in _staged[count:] if x[1] == keep]
    for _, path in later:
        drop_path(spark, path)


def _release() -> None:
    for spark, path in _staged:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
