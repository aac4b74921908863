import random

import duckdb
import numpy as np
import pytest

from tempora.operators import integrity, tiles
from tempora.plans import evidence_queries


def sides(spark):
    """A third of each side has one hash; the others are random or lie near one another."""
    rng = random.Random(5)
    hub = rng.getrandbits(63)
    near = lambda: hub ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 25)))
    make = lambda n: [(i, hub if i % 3 == 0 else rng.choice([rng.getrandbits(63), near()])) for i in range(n)]
    left, right = make(90), make(60) + [(60, 0)]
    return left, right, [spark.createDataFrame(x, "id long, hash long") for x in (left, right)]


@pytest.mark.parametrize("block", [4, 512])
def test_near_hashes_and_links(spark, monkeypatch, block):
    monkeypatch.setattr(integrity, "TILE_ROWS", 7)
    monkeypatch.setattr(tiles, "LEFT_ROWS", block)
    left, right, (a, b) = sides(spark)
    near = {(i, j): (x ^ y).bit_count() for i, x in left for j, y in right if (x ^ y).bit_count() <= 20}
    assert {(r["left_id"], r["right_id"]): r["distance"] for r in integrity.near_pairs(a, b, 20).collect()} == near
    # Copies aren't told pair by pair.
    hashes = integrity.near_hashes(a, b, 20).collect()
    assert len(hashes) == len(set(hashes)) == len({(dict(left)[i], dict(right)[j]) for i, j in near}) < len(near)
    got = {(r["side"], r["id"]): (r["class_id"], r["links"]) for r in integrity.near_links(a, b, 20).collect()}
    assert len(got) == len(left) + len(right)
    for side, rows in (("left", left), ("right", right)):
        for i, h in rows:
            links = sum(pair[side == "right"] == i for pair in near)
            assert got[side, i] == (min(j for j, x in rows if x == h), links)


def test_query_gives_each_pair_of_train_and_test(spark, tmp_path):
    """Which chunks are near one another and by how much, not how many: copies, a repeated id and missing vectors too."""
    rng = np.random.default_rng(3)
    copied = rng.normal(size=64)
    vectors = [copied if i % 4 == 0 else copied + rng.normal(size=64) * rng.choice([0.2, 1]) for i in range(80)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(8, copied.tolist(), 0), (80, None, 0), (88, None, 0), (98, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    single = lambda v: np.float32(v or [])
    hashes = [(i, sum(1 << k for k in np.flatnonzero(np.diff(single(v)) > 0).tolist())) for i, v, _ in rows]
    near = sorted((i, j, (x ^ y).bit_count()) for i, x in hashes if i % 10 < 6 for j, y in hashes if j % 10 > 7 and (x ^ y).bit_count() <= 20)
    got = evidence_queries.near_duplicate_hamming(spark, str(tmp_path))
    assert got.columns == ["left_id", "right_id", "distance"]
    assert sorted(map(tuple, got.collect())) == near
    assert len(near) > len(set(near)) > 100 and (80, 88, 0) in near
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(con.execute(evidence_queries.ORACLE_SQL["near_duplicate_hamming"]).fetchall()) == near


@pytest.mark.parametrize("block", [4, 512])
def test_pairs_of_large_groups(spark, monkeypatch, block):
    """Groups of copies go into several lists and batches, and no pair through a join or an exchange."""
    for name, value in (("LIST_ROWS", 4), ("BATCH_ROWS", 50)):
        monkeypatch.setattr(integrity, name, value)
    monkeypatch.setattr(tiles, "LEFT_ROWS", block)
    left, right, (a, b) = sides(spark)
    b = b.unionByName(b.where("id % 2 = 0")).unionByName(spark.createDataFrame([(None, left[0][1]), (5, None)], b.schema))
    right = right + right[::2] + [(None, left[0][1])]
    near = [(i, j, (x ^ y).bit_count()) for i, x in left for j, y in right if (x ^ y).bit_count() <= 20]
    found = integrity.near_pairs(a, b, 20)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(near, key=str) and len(near) > 1000
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    assert integrity._listed(a).selectExpr("max(size(ids))").first()[0] < 20 < a.groupBy("hash").count().selectExpr("max(count)").first()[0]
    assert not integrity.near_pairs(a, b.limit(0), 20).take(1) and not integrity.near_pairs(a.limit(0), b, 20).take(1)


def test_candidates_are_no_cross_join(spark):
    """No join by bits: what Spark joins are blocks of distinct hashes."""
    _, _, (a, b) = sides(spark)
    plan = integrity.near_hashes(a, b, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "band" not in plan and plan.count("Join") == 1
    assert integrity.near_hashes(a, b.limit(0), 20).count() == 0
    assert integrity.near_links(a, b.limit(0), 20).where("links = 0").count() == 90


@pytest.mark.parametrize("block", [7, 512])
def test_splits_and_nearest_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "LEFT_ROWS", block)
    rng = np.random.default_rng(5)
    rows = [("abc"[i % 3], i, int(h)) for i, h in enumerate(rng.integers(0, 1 << 10, 90))]
    df = spark.createDataFrame(rows, "split string, id long, hash long")
    got = {r["id"]: (r["class_id"], r["links"]) for r in integrity.split_links(df, 2).collect()}
    assert got == {i: (min(j for t, j, g in rows if t == s and g == h), sum(t != s and (g ^ h).bit_count() <= 2 for t, j, g in rows)) for s, i, h in rows}
    best = sorted(((h ^ g).bit_count(), i, j) for s, i, h in rows if s == "a" for t, j, g in rows if t != "a")[:20]
    assert [(r["distance"], r["left_id"], r["right_id"]) for r in integrity.nearest_pairs(df.where("split = 'a'"), df.where("split <> 'a'"), 20).collect()] == best
    every = sorted(((h ^ g).bit_count(), i, j) for s, i, h in rows for t, j, g in rows if s > t)[:20]
    assert [(r["distance"], r["left_id"], r["right_id"]) for r in integrity.nearest_across(df, 20).collect()] == every
    alone = {r["id"]: (r["class_id"], r["links"]) for r in integrity.split_links(df.where("split = 'a'"), 2).collect()}
    assert alone == {i: (min(j for t, j, g in rows if t == "a" and g == h), 0) for s, i, h in rows if s == "a"}


def test_ingest_names_what_is_wrong(spark):
    columns = "episode_id string, split string, split_group string, video string, video_sha256 string"
    row = lambda i, video="a..b/c.mp4", sha="0" * 64: (i, "train", "g" + i, video, sha)
    none, good = spark.createDataFrame([], columns), spark.createDataFrame([row("x")], columns)
    files = spark.createDataFrame([("a..b/c.mp4", "0" * 64)], "video string, sha256 string")
    assert integrity.ingest(none, good, found=files).count() == 1
    for bad, found in ((none, None), (spark.createDataFrame([row("x", "a/../b")], columns), None), (spark.createDataFrame([row("x", sha="1" * 64)], columns), files), (spark.createDataFrame([row("x", "other")], columns), files)):
        with pytest.raises(ValueError):
            integrity.ingest(none, bad, found=found)
