"""The convolution in blocks and in a stream: as the whole sequence says, however it is cut, late or begun again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import convolution
from tempora.plans import corpus_queries, learned_queries
from tempora.sources.staging import new_path
from tempora.streaming import automata, replay

NET = convolution.Network.random(2, 3, channels=4, layers=2, stages=2, seed=3)


def cells(spark, seed=0, episodes=3, most=60):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for e in range(episodes):
        n = int(rng.integers(1, most))
        x, ok, late = rng.normal(size=(n, 2)), rng.random(n) > 0.2, rng.integers(0, 40, n)
        best, released = NET(x, ok).argmax(1), np.maximum.accumulate(10 * np.arange(n) + late)
        rows += [(e, i, int(10 * i + late[i]), x[i].tolist(), bool(ok[i])) for i in range(n)]
        want |= {(e, i): (int(best[i]) if ok[i] else None, int(released[i])) for i in range(n)}
    return spark.createDataFrame(rows, "episode_id long, frame_index long, pts_us long, features array<double>, valid boolean"), want


@pytest.mark.parametrize("block_rows", [1, 5, 13, 4096])
def test_blocks_give_the_whole_result(spark, block_rows):
    table, want = cells(spark)
    got = {(r["episode_id"], r["frame_index"]): r["state"] for r in convolution.predict(table, NET, "features", "valid", block_rows=block_rows).collect()}
    assert got == {k: s for k, (s, _) in want.items()} and NET.reach == 13


@pytest.mark.parametrize("cuts", [[], [100], [7, 60, 61, 250, 400]])
def test_the_stream_gives_the_whole_result_however_it_is_cut(spark, cuts):
    table, want = cells(spark, 1)
    rows = replay.replayed(table, "episode_id", "pts_us", cuts, lambda s: automata.apply(s, automata.Predictions(NET))).collect()
    assert len(rows) == len(want)
    assert {(r["episode_id"], r["frame_index"]): (r["state"], r["released_us"]) for r in rows} == want


def test_a_stream_that_ends_midway_goes_on_from_its_checkpoint(spark):
    table, want = cells(spark, 2)
    source, checkpoint, out = (new_path(spark, f"test-{x}") for x in ("source", "state", "out"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", automata.ROCKSDB)
    try:
        for low, high in ((-1, 120), (120, 10**9)):
            table.where((F.col("pts_us") > low) & (F.col("pts_us") <= high)).repartition(1).write.mode("append").parquet(source)
            made = automata.apply(spark.readStream.schema(table.schema).parquet(source), automata.Predictions(NET))
            made.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch-{k}")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.option("recursiveFileLookup", "true").parquet(out).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(rows) == len(want) and {(r["episode_id"], r["frame_index"]): (r["state"], r["released_us"]) for r in rows} == want


def test_a_cell_that_comes_twice_raises(spark):
    table, _ = cells(spark, 3, episodes=1, most=20)
    again = table.limit(1).withColumn("pts_us", F.lit(10**6).cast("long"))
    with pytest.raises(Exception, match="came twice"):
        replay.replayed(table.unionByName(again), "episode_id", "pts_us", [10**5], lambda s: automata.apply(s, automata.Predictions(NET))).collect()


def test_queries_say_the_same(spark, sf):
    key = lambda r: (r["episode_id"], r["frame_index"])
    batch = {key(r): r["state"] for r in corpus_queries.causal_convolution(spark, sf).collect()}
    stream = {key(r): r["state"] for r in learned_queries.stream_predictions(spark, sf).collect()}
    assert stream == batch and len(set(batch.values())) > 1


@pytest.mark.parametrize("block_rows", [1, 6, 4096])
def test_the_loss_of_blocks_is_that_of_the_whole(spark, block_rows):
    """Each stage's loss, from its definition, over several episodes at once."""
    table, _ = cells(spark, 4)
    table = table.withColumn("truth", F.when(F.col("valid"), F.pmod(F.xxhash64("frame_index"), F.lit(3)).cast("int")))
    weights, episodes = np.array([1.0, 0.5, 2.0]), {}
    for r in table.orderBy("episode_id", "frame_index").collect():
        episodes.setdefault(r["episode_id"], []).append(r)
    want = [[0.0, 0, 0.0, 0] for _ in NET.stages]
    for rows in episodes.values():
        x, ok = np.array([r["features"] for r in rows]), np.array([r["valid"] for r in rows])
        for sums, logits in zip(want, NET.outputs(x, ok), strict=True):
            p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
            for t, r in enumerate(rows):
                if r["valid"]:
                    sums[0] -= weights[r["truth"]] * np.log(p[t, r["truth"]])
                    sums[1] += 1
                    if t and rows[t - 1]["valid"]:
                        sums[2] += sum(min(abs(np.log(a) - np.log(b)), 0.3) ** 2 for a, b in zip(p[t], p[t - 1], strict=True))
                        sums[3] += 3
    got = convolution.loss(table, NET, "features", "valid", "truth", 0.7, 0.3, weights.tolist(), block_rows=block_rows).orderBy("stage").collect()
    assert [r["rows"] for r in got] == [n for _, n, _, _ in want]
    assert np.allclose([r["loss"] for r in got], [e / n + 0.7 * c / m for e, n, c, m in want])
    one = [NET.outputs(np.array([r["features"] for r in rows]), np.array([r["valid"] for r in rows])) for rows in list(episodes.values())[:1]][0]
    rows = next(iter(episodes.values()))
    named, ok = np.array([r["truth"] if r["valid"] else -1 for r in rows]), np.array([r["valid"] for r in rows])
    alone = convolution.loss(table.where(F.col("episode_id") == rows[0]["episode_id"]), NET, "features", "valid", "truth", 0.7, 0.3, weights.tolist(), block_rows=block_rows)
    assert np.isclose(alone.agg(F.avg("loss")).first()[0], convolution.segmentation_loss(one, named, ok, 0.7, 0.3, weights))


def test_the_loss_without_rows_or_with_a_foreign_target(spark):
    table, _ = cells(spark, 5)
    none = table.withColumn("valid", F.lit(False)).withColumn("truth", F.lit(None).cast("int"))
    assert {r["loss"] for r in convolution.loss(none, NET, "features", "valid", "truth").collect()} == {0.0}
    with pytest.raises(Exception, match="no class"):
        convolution.loss(table.withColumn("truth", F.lit(9)), NET, "features", "valid", "truth").collect()
