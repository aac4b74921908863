"""Files and published tables: content hashes, frame listings, and publication that never changes what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import vectors as v
from tempora.operators.checks import require_none, violations
from tempora.operators.integrity import same_content


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verified(manifest: DataFrame, found: DataFrame, root: str = "") -> DataFrame:
    """The manifest's artifacts (name, sha256) that are missing or changed among found (path, sha256), or that point outside; a name is the path below root."""
    base = root.rstrip("/") + "/" if root else ""
    own = found.where(F.col("path").startswith(base)).select(F.substring("path", len(base) + 1, 1 << 20).alias("name"), F.col("sha256").alias("actual"))
    outside = F.array_contains(F.split("name", "/"), "..") | F.col("name").startswith("/")
    status = F.when(outside, "outside").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed")
    return manifest.join(own, "name", "left").select("name", status.alias("status")).where("status is not null")


def frame_files(paths: DataFrame) -> DataFrame:
    """index, rgb and graph of a folder's frame files Action_<index>_<camera>_(normal.png|graph.json), paired and gapless from 0."""
    pattern = r"(?:^|/)Action_(\d+)_(\d+)_(normal\.png|graph\.json)$"
    parts = paths.where(F.col("path").rlike(pattern)).select("path", *[F.regexp_extract("path", pattern, i).alias(n) for i, n in ((1, "index"), (2, "camera"), (3, "kind"))]).withColumn("index", F.col("index").cast("long"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path")))
    frames = parts.groupBy("index").agg(of("normal.png").alias("rgb"), of("graph.json").alias("graph"), F.count(F.lit(1)).alias("n"), F.count_distinct("camera").alias("cameras"))
    require_none(frames.where("rgb is null or graph is null or n != 2 or cameras != 1"), "unpaired frames")
    whole = frames.agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("last"))
    require_none(whole.where("n = 0 or last + 1 != n"), "frames aren't contiguous from zero")
    require_none(parts.agg(F.count_distinct("camera").alias("n")).where("n != 1"), "more than one camera")
    return frames.select("index", "rgb", "graph")


def selected(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames that are wanted (episode_id, frame_index); one that isn't there raises."""
    keys = ["episode_id", "frame_index"]
    require_none(wanted.join(frames.select(*keys), keys, "left_anti"), "frames that don't exist")
    return frames.join(wanted.select(*keys).distinct(), keys, "left_semi")


def sound_index(index: DataFrame, dimension: int, space_id: str) -> DataFrame:
    """Rows of an index that aren't of its space and dimension, or not of length one."""
    rules = {"space": F.col("space_id") == space_id, "dimension": F.size("vector") == dimension, "unit": v.is_unit(F.col("vector"))}
    return violations(index, rules, "chunk_id")


def publish(df: DataFrame, path: str) -> bool:
    """Writes a table once. Where there is one already it must hold the same rows; whether anything was written is returned."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if not same_content(df, spark.read.schema(df.schema).parquet(path)):
            raise ValueError(f"{path} holds other content")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def joined_population(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row for each sample with its label; a sample or label without the other, or twice, raises."""
    for side in (samples, labels):
        require_none(side.groupBy(key).count().where("count > 1"), "repeated ids")
    require_none(samples.join(labels, key, "left_anti"), "samples without a label")
    require_none(labels.join(samples, key, "left_anti"), "labels without a sample")
    return samples.join(labels, key)


def detections_by_frame(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Each frame with its list of boxes, an empty one where nothing was detected; a box of no frame raises. A frame's boxes are few."""
    require_none(detections.join(frames.select("frame_id"), "frame_id", "left_anti"), "detections without a frame")
    boxes = detections.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("box", "class", "score", "x1", "y1", "x2", "y2"))).alias("boxes"))
    empty = F.from_json(F.lit("[]"), boxes.schema["boxes"].dataType)
    return frames.join(boxes, "frame_id", "left").withColumn("boxes", F.coalesce("boxes", empty))


def merged_sources(parts: list[DataFrame], key: list[str], content: list[str], name: str) -> DataFrame:
    """Rows of several sources, one for each key, with the names under which it came; the same key with other content raises."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = both.groupBy(*key).agg(F.count_distinct(F.struct(*content)).alias("_n"), *[F.first(c).alias(c) for c in content], F.array_sort(F.collect_set(name)).alias("aliases"))
    require_none(merged.where("_n > 1"), "one key with different content")
    return merged.drop("_n")
