"""The vector index against an exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.retrieval import vector_candidates
from sparkloom.operators.vector_index import Codes, VectorIndex, unit

ROWS = "id bigint, embedding array<float>"


def recall(index, vectors, queries, k=10, **more):
    asked = queries.withColumnRenamed("id", "query_id")
    want, got = vector_candidates(vectors, asked, k), index.search(asked, k, **more)
    exact = {(r.query_id, r.id): r.score for r in want.collect()}
    found = {(r.query_id, r.id): r.score for r in got.collect()}
    # equal scores may stand for each other: what counts is a score that the exact list has
    least = {}
    for (q, _), s in exact.items():
        least[q] = min(s, least.get(q, 2.0))
    assert all(abs(exact[p] - s) < 2e-6 for p, s in found.items() if p in exact)
    return sum(s >= least[q] for (q, _), s in found.items()) / len(exact)


def test_recall_on_the_tables(spark, tmp_path):
    for sf in ("sf0.01", "sf0.1"):
        v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
        index = VectorIndex.build(v, str(tmp_path / sf), 64)
        assert recall(index, v, v.where("id % 20 = 0")) >= 0.9
        assert index.probes <= index.lists  # these vectors have no order: most lists have neighbours
        assert index.rows().select("id").distinct().count() == v.count()


def clusters(rng, n, d, groups):
    centres = rng.normal(size=(groups, d))
    x = centres[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, d))
    return [(i, row.astype(np.float32).tolist()) for i, row in enumerate(x)]


@pytest.fixture(scope="module")
def many(spark):
    return spark.createDataFrame(clusters(np.random.default_rng(3), 12_000, 32, 150), ROWS).repartition(4).cache()


def test_a_tenth_of_the_lists_has_nine_in_ten(spark, many, tmp_path):
    index = VectorIndex.build(many, str(tmp_path / "index"), 32)
    queries = many.where("id % 60 = 0")
    assert index.lists > 100 and index.probes <= 0.1 * index.lists and recall(index, many, queries) >= 0.9
    sizes = [r["count"] for r in index.rows().groupBy("list").count().collect()]
    assert len(sizes) == index.lists and sum(sizes) == many.count()


def test_added_rows_are_found(spark, many, tmp_path):
    index = VectorIndex.build(many.where("id % 3 > 0"), str(tmp_path / "index"), 32)
    index.add(many.where("id % 3 = 0"))
    assert recall(index, many, many.where("id % 60 = 0")) >= 0.9


def test_a_third_of_all_rows_alike_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = clusters(rng, 900, 8, 20)
    rows = [(i, rows[0][1] if i % 3 == 0 else x) for i, x in rows] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7), (1003, [])]
    v = spark.createDataFrame(rows, ROWS)
    index = VectorIndex.build(v, str(tmp_path / "index"), 8)
    assert index.rows().count() == len(rows) and {r.id for r in index.rows().where("list = -1").collect()} == {1000, 1001, 1002, 1003}
    assert recall(index, v, v.where("id < 900 AND id % 20 = 0")) >= 0.9
    assert index.search(spark.createDataFrame([(1, None), (2, [1.0])], "query_id bigint, embedding array<float>"), 3).count() == 0


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    index = VectorIndex.build(none, str(tmp_path / "index"), 8)
    assert index.search(none.withColumnRenamed("id", "query_id"), 3).count() == 0
    assert index.search(spark.createDataFrame([(1, [1.0] * 8)], "query_id bigint, embedding array<float>"), 3).count() == 0


def test_decoded_rows_have_the_products_of_their_words():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(400, 10)))
    codes = Codes.train(x, 6, 1)
    lists = codes.nearest(x, 1)[:, 0]
    rows = np.flatnonzero(lists == lists[0])
    coded, q = codes.encode(x[rows], lists[rows]), unit(rng.normal(size=(3, 10)))
    padded = np.pad(q, ((0, 0), (0, 2))).reshape(3, 3, 4)
    want = np.array([[a @ codes.centroids[lists[0]] + sum(p[s] @ codes.books[s, c[s]] for s in range(3)) for c in coded] for a, p in zip(q, padded)])
    assert np.allclose(q @ codes.decode(coded, lists[0]).T, want, atol=1e-6)
