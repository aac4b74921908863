import numpy as np
import pytest

from tempora.operators import retrieval, tiles


@pytest.mark.parametrize("rows", [(512, 2048), (100, 37), (2000, 2048), (2000, 37)])
def test_ranks_of_more_than_a_thousand_queries(spark, monkeypatch, rows):
    monkeypatch.setattr(tiles, "LEFT_ROWS", rows[0])
    monkeypatch.setattr(tiles, "RIGHT_ROWS", rows[1])
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (1_300, 4)) / 4  # few values: many ties
    vectors[::3] = vectors[0]
    table = [(i, [float(x) for x in v] if i != 7 else None) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(table, "chunk_id long, vector array<float>")
    found = retrieval.ranks(chunks, chunks.withColumnRenamed("chunk_id", "query_id"), 5).collect()
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found}
    assert len(found) == len(got) == 5 * len(vectors)
    for q, _ in table:
        score = vectors @ vectors[q]
        order = sorted(range(len(vectors)), key=lambda c: (c == 7, 0 if 7 in (q, c) else -score[c], c))[:5]
        assert [got[q, i + 1] for i in range(5)] == [(c, None if 7 in (q, c) else pytest.approx(score[c])) for c in order]


def test_top_two_of_more_than_a_thousand_classes(spark):
    classes = spark.createDataFrame([(c, [float(c), 1.0]) for c in range(1_200)], "class int, vector array<float>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id long, vector array<float>")
    got = {tuple(r) for r in retrieval.top_two(chunks, classes).collect()}
    assert got == {(1, 1199, 1.0), (2, 0, 1.0), (3, 0, 0.0)}
