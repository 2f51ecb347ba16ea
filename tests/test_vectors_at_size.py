"""Searches whose answers must not depend on the number of vectors or queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ivfpq, knn

RNG = np.random.default_rng(5)
X = RNG.normal(size=(3000, 8)).astype(np.float32).astype(np.float64)


def table(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(X)], "vec_id long, embedding array<float>").repartition(3)


def exact(metric, q, k):
    d = knn.pair_distances(X, np.broadcast_to(X[q], X.shape), metric)
    return [(int(i), round(float(d[i]), 9)) for i in np.lexsort((np.arange(len(d)), d))[:k]]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot", "manhattan"])
def test_refined_is_exact_in_the_probed_cells(spark, metric):
    """Codes of two values tell little: 5 x 2 candidates of 3,000 vectors used to miss most neighbours."""
    rows = table(spark)
    asked = rows.where("vec_id % 500 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = ivfpq.IvfPq(spark, ivfpq.IvfPqConfig(8, clusters=4, subvectors=2, codes=2, metric=metric, probes=4)).build(rows)
    got = {}
    for r in index.refined(rows, asked, 5, 2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.distance, 9)))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: exact(metric, q, 5) for q in range(0, 3000, 500)}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_many_queries(spark, monkeypatch, metric):
    """Over several blocks of queries and vectors, with copies whose distances tie."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 100)
    rows = table(spark)
    copies = rows.unionByName(rows.where("vec_id < 300").select((F.col("vec_id") + 10_000).alias("vec_id"), "embedding"))
    asked = rows.where("vec_id < 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): r.id for r in knn.nearest_many(copies, asked, 2, metric, digits=6).collect()}
    assert got == {(q, k + 1): q + 10_000 * k for q in range(300) for k in (0, 1)}


def test_no_matrix_of_all_queries(monkeypatch):
    """What a worker holds is bounded: 2,000 queries used to meet a whole batch in one matrix."""
    seen, whole = [], knn.matrix_distances
    monkeypatch.setattr(knn, "matrix_distances", lambda q, x, metric: seen.append(len(q) * len(x)) or whole(q, x, metric))
    best = knn.Best(2000, 3)
    knn.compare(best, X[:2000], np.arange(2000), X[:2000], "euclidean")
    assert max(seen) <= knn.QUERY_ROWS * knn.VECTOR_ROWS and best.id[:, 0].tolist() == list(range(2000))
