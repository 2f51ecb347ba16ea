"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, distance
from .worker import prepare

#: Queries that travel to the workers at once.
QUERY_BLOCK = 1 << 16
#: Queries, and vectors, of one matrix of distances: what a worker holds doesn't depend on their numbers.
QUERY_ROWS, VECTOR_ROWS = 256, 2048


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "euclidean", vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, distance) of the ``k`` nearest, ties by id: a top-k that keeps ``k`` rows a task."""
    d = distance(metric, F.col(column), query)
    return vectors.where(F.col(column).isNotNull()).select(F.col(vector_id).alias("id"), d.alias("distance")).orderBy("distance", "id").limit(k)


def matrix_distances(queries: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every query to every row."""
    if metric == "manhattan":
        return np.stack([np.abs(x - q).sum(axis=1) for q in queries])
    p = queries @ x.T
    if metric == "dot":
        return -p
    if metric == "euclidean":
        return np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * p, 0))
    n = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return 1 - np.divide(p, n, out=np.zeros_like(p), where=n > 0)


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of equal rows of two matrices, by sums of their own: equal vectors get equal distances, wherever they stand."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    if metric == "manhattan":
        return np.abs(a - b).sum(axis=1)
    p = (a * b).sum(axis=1)
    if metric == "dot":
        return -p
    n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return 1 - np.divide(p, n, out=np.zeros_like(p), where=n > 0)


def slack(queries: np.ndarray, x: np.ndarray, metric: str) -> float:
    """More than a distance by a matrix product may be off."""
    if metric == "cosine":
        return 1e-9
    size = max(1.0, float(np.abs(queries).max(initial=0)), float(np.abs(x).max(initial=0))) * x.shape[1] ** 0.5
    return 1e-6 * size if metric == "euclidean" else 1e-11 * size * size


class Best:
    """The ``k`` smallest distances of each of ``n`` queries so far, ties by id; with ``digits`` distances tie that round alike."""

    def __init__(self, n: int, k: int, digits: int | None = None):
        self.k, self.digits = k, digits
        self.distance, self.id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def edge(self, rows: slice) -> np.ndarray:
        """What a distance must not be above to count, by query."""
        return self.distance[rows].max(axis=1) + (10.0**-self.digits if self.digits is not None else 0)

    def add(self, query: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        touched, query = np.unique(query, return_inverse=True)
        if not len(touched):
            return
        query = np.concatenate([np.repeat(np.arange(len(touched)), self.k), query])
        ids, distances = np.concatenate([self.id[touched].ravel(), ids]), np.concatenate([self.distance[touched].ravel(), distances])
        order = np.lexsort((ids, distances if self.digits is None else np.round(distances, self.digits), query))
        first = np.searchsorted(query[order], np.arange(len(touched)))
        chosen = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.id[touched], self.distance[touched] = ids[chosen].reshape(-1, self.k), distances[chosen].reshape(-1, self.k)

    def batches(self, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(query_id, id, distance) of what was found."""
        for a in range(0, len(queries), QUERY_ROWS):
            i, j = np.nonzero(self.distance[a : a + QUERY_ROWS] < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(queries[a + i]), pa.array(self.id[a + i, j]), pa.array(self.distance[a + i, j])], ["query_id", "id", "distance"])


def vector_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def compare(best: Best, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, metric: str) -> None:
    """Take every row of ``x`` into account for every query: a matrix product tells which are near, sums of their own how near."""
    for a in range(0, len(queries), QUERY_ROWS):
        q, rows = queries[a : a + QUERY_ROWS], slice(a, a + QUERY_ROWS)
        d = matrix_distances(q, x, metric)
        edge = best.edge(rows)
        if len(ids) > best.k and np.isinf(edge).any():
            edge = np.minimum(edge, np.partition(d, best.k - 1, axis=1)[:, best.k - 1] + (10.0**-best.digits if best.digits is not None else 0))
        i, j = np.nonzero(d <= (edge + 2 * slack(q, x, metric))[:, None])
        for s in range(0, len(i), 1 << 17):
            u, v = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            best.add(u + a, ids[v], pair_distances(x[v], q[u], metric))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ``QUERY_BLOCK`` queries at a time; null ones are left out."""
    block = []
    for r in queries.select(F.col(queries.columns[0]).cast("long").alias("q"), F.col(queries.columns[1]).cast("array<double>").alias("v")).where("v is not null").toLocalIterator(prefetchPartitions=True):
        block.append(r)
        if len(block) == QUERY_BLOCK:
            yield np.array([r.q for r in block]), np.array([r.v for r in block], np.float64)
            block = []
    if block:
        yield np.array([r.q for r in block]), np.array([r.v for r in block], np.float64)


def ranked(spark, parts: list[DataFrame], k: int, digits: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of the ``k`` nearest among what the tasks found."""
    found = parts[0] if parts else spark.createDataFrame([], "query_id long, id long, distance double")
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("distance" if digits is None else F.round("distance", digits), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", vector_id: str = "vec_id", column: str = "embedding", query_id: str = "query_id", query_column: str = "query", digits: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank) for a table of queries; with ``digits`` distances tie that round alike.

    Every task compares its vectors with all queries by matrix products of
    bounded size, and sends only its ``k`` best for each query.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = vectors.sparkSession
    prepare(spark)
    kept = vectors.where(F.col(column).isNotNull()).select(F.col(vector_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))

    def search(names: np.ndarray, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            best = Best(len(names), k, digits)
            for batch in batches:
                for a in range(0, batch.num_rows, VECTOR_ROWS):
                    part = batch.slice(a, VECTOR_ROWS)
                    compare(best, matrix, part.column("id").to_numpy(zero_copy_only=False), vector_matrix(part.column("v")), metric)
            yield from best.batches(names)

        return kept.mapInArrow(run, "query_id long, id long, distance double")

    return ranked(spark, [search(*block) for block in query_blocks(queries.select(query_id, query_column))], k, digits)
