"""IVF-PQ: an inverted file of coarse cells with product-quantised codes.

Codebooks are fitted on a bounded sample; every vector is encoded by one
narrow pass and the index is a table partitioned by cell.  A search meets
vectors of the probed cells only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .knn import QUERY_ROWS, VECTOR_ROWS, Best, matrix_distances, pair_distances, query_blocks, ranked, slack, vector_matrix
from .worker import prepare


@dataclass(frozen=True)
class IvfPqConfig:
    dimension: int
    clusters: int = 64
    subvectors: int = 8
    codes: int = 256
    metric: str = "euclidean"
    probes: int = 10
    sample_rows: int = 50_000
    seed: int = 17

    def __post_init__(self):
        if self.dimension % self.subvectors:
            raise ValueError("the dimension must be a multiple of the number of subvectors")


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, metric: str = "euclidean") -> np.ndarray:
    """k-means; an empty cluster keeps its centroid, and moves below 1e-6 end it."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([matrix_distances(c, x[a : a + 4096], metric).argmin(axis=0) for a in range(0, len(x), 4096)])
        new = c.copy()
        for i in np.unique(near):
            new[i] = x[near == i].mean(axis=0)
        done = np.abs(new - c).max() <= 1e-6
        c = new
        if done:
            break
    return c


class IvfPq:
    """``build`` then ``search``; ``add``, ``remove``, ``save`` and ``load`` work on the index table."""

    def __init__(self, spark: SparkSession, config: IvfPqConfig):
        self.spark, self.config = spark, config
        self.coarse: np.ndarray | None = None
        self.books: np.ndarray | None = None
        self.table: DataFrame | None = None

    @property
    def is_built(self) -> bool:
        return self.table is not None

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        """Cosine works on unit vectors."""
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if self.config.metric == "cosine" else x

    def build(self, vectors: DataFrame, vector_id: str = "vec_id", column: str = "embedding") -> "IvfPq":
        """Fit on at most ``sample_rows`` vectors (by hash of the id), then encode all."""
        c, rng = self.config, np.random.default_rng(self.config.seed)
        rows = vectors.where(F.col(column).isNotNull())
        if rows.where(F.size(column) != c.dimension).limit(1).count():
            raise ValueError(f"vectors must have {c.dimension} components")
        sample = rows.orderBy(F.xxhash64(vector_id), vector_id).limit(c.sample_rows).select(F.col(column).cast("array<double>").alias("v")).toArrow()
        x = self._prepared(np.asarray(sample.column(0).combine_chunks().flatten(), np.float64).reshape(-1, c.dimension))
        if not len(x):
            raise ValueError("no vectors to build from")
        self.coarse = lloyd(x, c.clusters, 50, rng, c.metric)
        width = c.dimension // c.subvectors
        books = [lloyd(x[:, m * width : (m + 1) * width], c.codes, 20, rng) for m in range(c.subvectors)]
        self.books = np.stack([np.concatenate([b, np.full((c.codes - len(b), width), np.inf)]) if len(b) < c.codes else b for b in books])
        self.table = self.encode(rows, vector_id, column)
        return self

    def encode(self, rows: DataFrame, vector_id: str, column: str) -> DataFrame:
        """(id, cluster_id, codes) of vectors; the nearest centroid wins, the first on ties."""
        prepare(self.spark)
        coarse, books, c = self.coarse, self.books, self.config

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width = c.dimension // c.subvectors
            for batch in batches:
                x = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, c.dimension)
                norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if c.metric == "cosine" else 1.0
                x = x / norm
                cell = matrix_distances(coarse, x, c.metric).argmin(axis=0) if len(x) else np.empty(0, np.int64)
                codes = np.empty((len(x), c.subvectors), np.int16)
                for m in range(c.subvectors):
                    real = np.isfinite(books[m, :, 0])
                    codes[:, m] = matrix_distances(books[m][real], x[:, m * width : (m + 1) * width], "euclidean").argmin(axis=0) if len(x) else 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * c.subvectors, pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), lists], ["id", "cluster_id", "codes"])

        chosen = rows.select(F.col(vector_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
        return chosen.mapInArrow(run, "id long, cluster_id int, codes array<short>")

    def _tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query: which cells to probe, and what each code of each subvector adds to the distance."""
        c = self.config
        if q.shape[1] != c.dimension:
            raise ValueError(f"the query must have {c.dimension} components")
        q = self._prepared(q)
        near = matrix_distances(q, self.coarse, c.metric).argsort(axis=1, kind="stable")[:, : c.probes]
        probed = np.zeros((len(q), len(self.coarse)), bool)
        np.put_along_axis(probed, near, True, axis=1)
        width, parts = c.dimension // c.subvectors, []
        for m in range(c.subvectors):
            part, book = q[:, m * width : (m + 1) * width], np.where(np.isfinite(self.books[m]), self.books[m], 0)
            if c.metric == "euclidean":
                parts.append(matrix_distances(part, book, "euclidean") ** 2)
            else:
                parts.append(matrix_distances(part, book, "manhattan" if c.metric == "manhattan" else "dot"))
        return probed, np.stack(parts, axis=1)

    def _by_code(self, added: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of every query to every vector by its codes."""
        total = sum(added[:, m][:, codes[:, m]] for m in range(codes.shape[1]))
        return {"euclidean": np.sqrt, "cosine": lambda x: 1.0 + x}.get(self.config.metric, lambda x: x)(total)

    def _bare(self) -> "IvfPq":
        """The codebooks alone, for workers."""
        bare = IvfPq(None, self.config)
        bare.coarse, bare.books = self.coarse, self.books
        return bare

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """(id, distance) of the ``k`` nearest by code, from the probed cells."""
        queries = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        return self.search_many(queries, k).drop("query_id", "rank")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance, rank) by code: every task sends its ``k`` best for each query."""
        return self._run(self.table, queries, k, None).orderBy("query_id", "rank")

    def refined(self, vectors: DataFrame, queries: DataFrame, k: int, fetch: int = 10, vector_id: str = "vec_id", column: str = "embedding") -> DataFrame:
        """(query_id, id, distance, rank): the ``k`` nearest of all vectors in the probed cells by their exact distances; ``vectors`` are the indexed ones.

        ``fetch`` times ``k`` candidates by code tell how near the nearest are
        at least.  After these, every vector is ranked whose distance by code,
        less the error of its own code, doesn't prove it farther: nothing near is lost, however many vectors there are.
        """
        own = vectors.where(F.col(column).isNotNull()).select(F.col(vector_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
        # Any code bounds the distance of any vector, so where an id is repeated one of its rows in the index serves all.
        return self._run(own.join(self.table.dropDuplicates(["id"]), "id") if self.is_built else None, queries, k, fetch)

    def _run(self, rows: DataFrame | None, queries: DataFrame, k: int, fetch: int | None) -> DataFrame:
        if not self.is_built:
            raise RuntimeError("the index is not built")
        prepare(self.spark)

        def search(names: np.ndarray, matrix: np.ndarray) -> DataFrame:
            if matrix.shape[1] != self.config.dimension:
                raise ValueError(f"the query must have {self.config.dimension} components")
            sent = self.spark.sparkContext.broadcast((self._bare(), names, matrix))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                index, names, matrix = sent.value
                best = Best(len(names), k)
                for whole in batches:
                    for start in range(0, whole.num_rows, VECTOR_ROWS):
                        batch = whole.slice(start, VECTOR_ROWS)
                        index._compare(best, matrix, batch, fetch)
                yield from best.batches(names)

            return rows.mapInArrow(run, "query_id long, id long, distance double")

        return ranked(self.spark, [search(*block) for block in query_blocks(queries.select("query_id", "query"))], k)

    def _compare(self, best: Best, queries: np.ndarray, batch: pa.RecordBatch, fetch: int | None) -> None:
        """Take a batch of the index into account: by code alone, or with ``fetch`` by exact distances of its vectors."""
        metric, k = self.config.metric, best.k
        ids, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "cluster_id"))
        codes = np.asarray(batch.column("codes").flatten()).reshape(len(ids), -1)
        if fetch is not None:
            x = self._prepared(vector_matrix(batch.column("v")))
            width = self.config.dimension // self.config.subvectors
            off = x - np.concatenate([self.books[m][codes[:, m]] for m in range(x.shape[1] // width)], axis=1)
            error = np.abs(off).sum(axis=1) if metric == "manhattan" else np.sqrt((off**2).sum(axis=1))
        for a in range(0, len(queries), QUERY_ROWS):
            rows, q = slice(a, a + QUERY_ROWS), self._prepared(queries[a : a + QUERY_ROWS])
            probed, added = self._tables(queries[rows])
            probed = probed[:, cell]
            d = np.where(probed, self._by_code(added, codes), np.inf)
            edge = best.edge(rows)
            if fetch is None:
                if len(ids) > k and np.isinf(edge).any():
                    edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero((d <= edge[:, None]) & probed)
                best.add(i + a, ids[j], d[i, j])
                continue
            open_ = np.flatnonzero(np.isinf(edge))
            most = k * fetch
            if len(open_) and len(ids) > most:
                # The k-th exact distance among the best by code: no farther vector is among the k nearest.
                near = np.argpartition(d[open_], most - 1, axis=1)[:, :most]
                there = np.stack([pair_distances(x[v], np.broadcast_to(q[u], (most, q.shape[1])), metric) for u, v in zip(open_, near)])
                there[~np.take_along_axis(probed[open_], near, axis=1)] = np.inf
                edge[open_] = np.partition(there, k - 1, axis=1)[:, k - 1]
            reach = edge + 2 * slack(q, x, metric)
            d -= error * (np.linalg.norm(q, axis=1)[:, None] if metric == "dot" else 1.0)
            near = probed & (d <= reach[:, None])
            if near.sum() > near.size // 50:
                near &= matrix_distances(q, x, metric) <= reach[:, None]
            i, j = np.nonzero(near)
            for s in range(0, len(i), 1 << 17):
                u, v = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
                best.add(u + a, ids[v], pair_distances(x[v], q[u], metric))

    def add(self, vectors: DataFrame, vector_id: str = "vec_id", column: str = "embedding") -> None:
        """Encode more vectors with the present codebooks."""
        if not self.is_built:
            raise RuntimeError("the index is not built")
        self.table = self.table.unionByName(self.encode(vectors.where(F.col(column).isNotNull()), vector_id, column))

    def remove(self, ids: DataFrame | Sequence[int]) -> None:
        """Drop vectors by id."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        self.table = self.table.join(gone.select(F.col(gone.columns[0]).cast("long").alias("id")), "id", "left_anti")

    def save(self, path: str) -> None:
        """The table by cell, and the codebooks as one row."""
        self.table.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/cells")
        books = json.dumps({"config": asdict(self.config), "coarse": self.coarse.tolist(), "books": np.where(np.isfinite(self.books), self.books, 1e300).tolist()})
        self.spark.createDataFrame([(books,)], "content string").write.mode("overwrite").parquet(f"{path}/books")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IvfPq":
        content = json.loads(spark.read.parquet(f"{path}/books").first()[0])
        index = cls(spark, IvfPqConfig(**content["config"]))
        index.coarse = np.array(content["coarse"])
        books = np.array(content["books"])
        index.books = np.where(books >= 1e300, np.inf, books)
        index.table = spark.read.parquet(f"{path}/cells")
        return index

    def stats(self) -> dict:
        """Vectors, cells and bytes: codes, ids, centroids and codebooks."""
        n, c = self.table.count(), self.config
        size = n * (c.subvectors + 8) + self.coarse.size * 4 + self.books.size * 4
        return {"vectors": n, "clusters": len(self.coarse), "size_bytes": int(size), "dimension": c.dimension, "metric": c.metric}


def create_index(spark: SparkSession, kind: str, config: IvfPqConfig) -> IvfPq:
    """The index of a kind: ``ivf_pq``; ``diskann`` is announced but not available."""
    if kind == "ivf_pq":
        return IvfPq(spark, config)
    if kind == "diskann":
        raise NotImplementedError("the DiskANN index is not implemented")
    raise ValueError(f"unknown index: {kind}")
