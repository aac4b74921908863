"""Identity, leakage and near-duplicate checks over registered content."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempora.operators import tiles
from tempora.operators.checks import in_several

#: Rows of a tile of hashes: tiles whose population counts lie too far apart are skipped.
TILE_ROWS = 256

#: Ids in a list of a hash's rows, about, and pairs in an Arrow batch, about.
LIST_ROWS, BATCH_ROWS = 256, 1 << 17


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_leakage(registered: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Values of any key that live in more than one split: key, value, owners, n."""
    tables = [in_several(registered, k, split).select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), "owners", "n") for k in keys]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def gradient_bits(vector: Column, bits: int = 63) -> Column:
    """A perceptual hash: bit i is set where element i + 1 is larger than element i."""
    steps = F.zip_with(F.slice(vector, 1, bits), F.slice(vector, 2, bits), lambda a, b: b > a)
    return F.aggregate(F.transform(steps, lambda s, i: F.when(s, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def tile_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in left and right of hashes within the radius, and their distances, tile by tile in order of population count."""
    by_count = lambda h: (order := np.argsort(np.bitwise_count(h), kind="stable"), np.bitwise_count(h)[order].astype(int))
    (a_order, a_count), (b_order, b_count) = by_count(left), by_count(right)
    for i in range(0, len(left), TILE_ROWS):
        a = slice(i, i + TILE_ROWS)
        for j in range(0, len(right), TILE_ROWS):
            b = slice(j, j + TILE_ROWS)
            if b_count[b][0] - a_count[a][-1] > radius or a_count[a][0] - b_count[b][-1] > radius:
                continue
            distance = np.bitwise_count(left[a_order[a]][:, None] ^ right[b_order[b]][None, :])
            x, y = np.nonzero(distance <= radius)
            yield a_order[a][x], b_order[b][y], distance[x, y].astype(np.int32)


def _hashes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def near_hashes(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """Pairs of distinct hashes within the radius, each once: l, r, distance. The ids of a hash are its rows in left or right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in tiles.pairs(batches):
            l, r = (x.field("hash").to_numpy() for x in (a, b))  # noqa: E741
            for x, y, distance in tile_pairs(l.view(np.uint64), r.view(np.uint64), radius):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(l[x]), pa.array(r[y]), pa.array(distance)], ["l", "r", "distance"])

    return tiles.meeting(_hashes(left).select("hash"), _hashes(right).select("hash"), "hash").mapInArrow(run, "l long, r long, distance int")


def _listed(rows: DataFrame) -> DataFrame:
    """key, hash and ids: the rows of each hash, in lists of about LIST_ROWS at most."""
    many = _hashes(rows).where(F.col("n") > LIST_ROWS)
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / LIST_ROWS), F.lit(1)))
    lists = rows.where(F.col("hash").isNotNull()).join(many, "hash", "left").groupBy("hash", part.alias("part")).agg(F.collect_list(F.struct("id")).alias("ids"))
    return lists.select(F.xxhash64("hash", "part").alias("key"), "hash", "ids")


def each_with_each(a_at: np.ndarray, a_n: np.ndarray, b_at: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of places (where they begin and how long they are), two by two: which two, and all pairs of a place in one and one in the other."""
    n = a_n * b_n
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, a_at[of] + nth // b_n[of], b_at[of] + nth % b_n[of]


def near_pairs(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """Pairs of rows whose hashes lie within the radius: left_id, right_id, distance.

    Distinct hashes are compared, all with all, and tasks write out the pairs of their ids where they compare them: no pair is
    shuffled, and a batch at a time is held. Copies on both sides give as many rows as there are pairs of them, repeated ids as
    well: near_links only counts them for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in tiles.pairs(batches):
            (l, l_ids), (r, r_ids) = ((x.field("hash").to_numpy().view(np.uint64), x.field("ids")) for x in (a, b))
            l_n, r_n = (x.value_lengths().to_numpy().astype(np.int64) for x in (l_ids, r_ids))
            l_at, r_at = np.cumsum(l_n) - l_n, np.cumsum(r_n) - r_n
            l_id, r_id = (x.flatten().field("id") for x in (l_ids, r_ids))
            for x, y, distance in tile_pairs(l, r, radius):
                cuts = np.flatnonzero(np.diff(np.cumsum(l_n[x] * r_n[y]) // BATCH_ROWS)) + 1
                for u, v, d in zip(*(np.split(z, cuts) for z in (x, y, distance)), strict=True):
                    of, i, j = each_with_each(l_at[u], l_n[u], r_at[v], r_n[v])
                    if len(of):
                        yield pa.RecordBatch.from_arrays([l_id.take(pa.array(i)), r_id.take(pa.array(j)), pa.array(d[of])], ["left_id", "right_id", "distance"])

    return tiles.meeting(_listed(left), _listed(right), "key").mapInArrow(run, "left_id long, right_id long, distance int")


def near_links(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """side (left or right), id, class_id (the least id of the side with the same hash) and links, the number of rows of the other
    side within the radius, of each row. A row without a hash has neither. Tasks hand on sums a hash, never pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in tiles.pairs(batches):
            (l, l_n), (r, r_n) = ((x.field("hash").to_numpy(), x.field("n").to_numpy()) for x in (a, b))
            of_l, of_r = np.zeros(len(l), np.int64), np.zeros(len(r), np.int64)
            for x, y, _ in tile_pairs(l.view(np.uint64), r.view(np.uint64), radius):
                np.add.at(of_l, x, r_n[y])
                np.add.at(of_r, y, l_n[x])
            sides = pa.array(["left"] * len(l) + ["right"] * len(r))
            yield pa.RecordBatch.from_arrays([sides, pa.array(np.r_[l, r]), pa.array(np.r_[of_l, of_r])], ["side", "hash", "links"])

    met = tiles.meeting(_hashes(left), _hashes(right), "hash").mapInArrow(run, "side string, hash long, links long")
    links = met.groupBy("side", "hash").agg(F.sum("links").alias("links"))
    rows = left.select(F.lit("left").alias("side"), "id", "hash").unionByName(right.select(F.lit("right").alias("side"), "id", "hash"))
    classes = rows.where(F.col("hash").isNotNull()).groupBy("side", "hash").agg(F.min("id").alias("class_id")).join(links, ["side", "hash"], "left")
    found = rows.join(classes, ["side", "hash"], "left")
    return found.select("side", "id", "class_id", F.when(F.col("hash").isNotNull(), F.coalesce("links", F.lit(0))).cast("long").alias("links"))


def split_links(rows: DataFrame, radius: int) -> DataFrame:
    """split, id, class_id (the least id of the split with the same hash) and links, the rows of other splits within the radius. rows: split, id, hash.

    Each two splits meet once, and say what either has of the other.
    """
    found = None
    for one, other in pairs_of(rows, "split"):
        both = near_links(rows.where(F.col("split") == one), rows.where(F.col("split") == other), radius)
        own = both.select(F.when(F.col("side") == "left", one).otherwise(other).alias("split"), "id", "class_id", "links")
        found = own if found is None else found.unionByName(own)
    if found is None:
        first = F.when(F.col("hash").isNotNull(), F.min("id").over(W.partitionBy("split", "hash")))
        return rows.select("split", "id", first.alias("class_id"), F.when(F.col("hash").isNotNull(), F.lit(0)).cast("long").alias("links"))
    return found.groupBy("split", "id", "class_id").agg(F.sum("links").alias("links"))


def pairs_of(rows: DataFrame, split: str) -> list[tuple[str, str]]:
    """Any two of the values of a column, a handful."""
    return list(itertools.combinations(sorted(r[0] for r in rows.select(split).where(F.col(split).isNotNull()).distinct().collect()), 2))


def nearest_across(rows: DataFrame, k: int) -> DataFrame:
    """The k pairs of rows of different splits whose hashes differ least: left_id, right_id (left's split is the one that comes later by name), distance. rows: split, id, hash."""
    found = None
    for one, other in pairs_of(rows, "split"):
        own = nearest_pairs(rows.where(F.col("split") == other), rows.where(F.col("split") == one), k)
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise ValueError("fewer than two splits")
    return found.orderBy("distance", "left_id", "right_id").limit(k)


def nearest_pairs(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k pairs of a row of left and one of right whose hashes differ least, of equals those of lower ids: left_id, right_id, distance. Tasks hand on k pairs a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in tiles.pairs(batches):
            (l, l_id), (r, r_id) = ((x.field("hash").to_numpy(), x.field("id").to_numpy()) for x in (a, b))
            distance = np.bitwise_count(l.view(np.uint64)[:, None] ^ r.view(np.uint64)[None, :]).astype(np.int32)
            most = np.partition(distance, min(k, distance.size) - 1, axis=None)[min(k, distance.size) - 1]
            x, y = np.nonzero(distance <= most)
            first = np.lexsort((r_id[y], l_id[x], distance[x, y]))[:k]
            x, y = x[first], y[first]
            yield pa.RecordBatch.from_arrays([pa.array(l_id[x]), pa.array(r_id[y]), pa.array(distance[x, y])], ["left_id", "right_id", "distance"])

    known = lambda rows: rows.where("id is not null and hash is not null").select("id", "hash")
    return tiles.meeting(known(left), known(right), "id").mapInArrow(run, "left_id long, right_id long, distance int").orderBy("distance", "left_id", "right_id").limit(k)


def ingest(registry: DataFrame, manifest: DataFrame, splits=("train", "development", "test"), found: DataFrame | None = None) -> DataFrame:
    """The manifest's new episodes, if the whole manifest is sound; else nothing is taken and the reasons are raised.

    A manifest has at least a row, and exactly episode_id, split, split_group, video, video_sha256. With found (video, sha256: the
    files as they are), each video must be there with the content that the manifest names.
    """
    from tempora.operators.checks import require_columns, require_none, violations

    require_columns(manifest, {"episode_id", "split", "split_group", "video", "video_sha256"})
    rules = {"id": F.col("episode_id").rlike("^[A-Za-z0-9_-]+$"), "split": F.col("split").isin(*splits), "hash": F.col("video_sha256").rlike("^[0-9a-f]{64}$"), "path": ~F.array_contains(F.split("video", "/"), "..") & ~F.col("video").startswith("/")}
    require_none(manifest.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "an empty manifest")
    require_none(violations(manifest, rules, "episode_id"), "rows break rules")
    require_none(manifest.groupBy("episode_id").count().where("count > 1"), "repeated ids")
    if found is not None:
        require_none(manifest.join(found, "video", "left").where(~F.col("sha256").eqNullSafe(F.col("video_sha256"))).select("episode_id"), "files that are missing or changed")
    both = registry.select(*manifest.columns).unionByName(manifest)
    require_none(split_leakage(both, ["split_group", "video_sha256"]), "content or group in two splits")
    require_none(both.distinct().groupBy("episode_id").count().where("count > 1"), "changed content under a known id")
    return manifest.join(registry.select("episode_id"), "episode_id", "left_anti")


def missing_features(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """What a cache of features by key lacks; keys are distinct before the costly producer sees them."""
    return wanted.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def same_content(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated ones as often."""
    return not left.exceptAll(right).take(1) and not right.exceptAll(left).take(1)
