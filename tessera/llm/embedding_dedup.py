"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted by k-means on a
bounded sample; their product is a grid of cells.  Every vector stands in one
home cell, and visits its nearest cells in the order of the multi-sequence
traversal.  How many it visits is set by measurement: probe vectors are
compared with *all* vectors, and the visit count is the least that finds the
target share of their true neighbours, themselves left out, as a mean over
probes.  More probes are drawn until enough of them have a neighbour; if they
stay too few, vectors at exactly the least cosine from the sample, in random
directions, stand in for neighbours: the farthest that a link may be, so that
closer ones are found at least as often.  The search for that count begins
with ``first_visits`` places and doubles them while the target is missed, up
to all cells of the grid, which is exact; nothing is cut silently.  In each cell
visitors are verified against residents in double precision, by blocked matrix products.

Equal vectors form one class and are compared once.  A cell with many visitors
or residents is split by hash into blocks on both sides; only counts and
spanning edges leave a block, never pairs, and no partner is capped.

Edge cases: null or zero vectors and those with null or non-finite components
link with nothing; shorter vectors count as padded with zeros; equal rows link
with each other; a row without ``vec_id`` links and counts like any other, but
names a component only if no row of it has an id (then null), and is kept only
then; an empty table gives an empty table; further columns are ignored,
whatever their names.  A link counts for both ends whichever of them found it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import materialise, prepare


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd rounds from a random start; empty clusters keep theirs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.half = left, right, left.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, k: int) -> "Grid":
        half = max(1, sample.shape[1] // 2)
        x = unit(sample)
        rest = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))
        return cls(k_means(x[:, :half], k), k_means(rest, k, seed=6))

    def _distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = x[:, : self.half], x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1))
        return (self.left**2).sum(1) - 2 * a @ self.left.T, (self.right**2).sum(1) - 2 * b @ self.right.T

    def visits(self, x: np.ndarray, t: int) -> np.ndarray:
        """The ``t`` nearest cells of each unit vector, nearest first.

        A cell of the i-th and j-th nearest centroids comes after i * j cells
        that are nearer, so only those with i * j <= t are put in sequence.
        """
        out = []
        for chunk in np.array_split(x, max(1, len(x) // 4096 + 1)):
            a, b = self._distances(chunk)
            oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
            a, b = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
            i, j = np.array([(i, j) for i in range(a.shape[1]) for j in range(b.shape[1]) if (i + 1) * (j + 1) <= t]).T
            first = np.argsort(a[:, i] + b[:, j], axis=1, kind="stable")[:, :t]
            out.append(np.take_along_axis(oa[:, i] * b.shape[1] + ob[:, j], first, 1))
        return np.concatenate(out).astype(np.int64)

    def places(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """At which place of its sequence each ``x`` meets the home of its ``y``; ``most`` if at none."""
        hit = self.visits(x, most) == self.visits(y, 1)
        return np.where(hit.any(axis=1), hit.argmax(axis=1), most)

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as doubles, padded with zeros to ``dim``."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def at_cosine(x: np.ndarray, cosine: float, seed: int = 4) -> np.ndarray:
    """Unit vectors in random directions at ``cosine`` from the unit vectors ``x``."""
    z = np.random.default_rng(seed).normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z


def _verify(least: float, dim: int):
    """Links of one block of a cell: visitors against residents."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        resident = rows.column("resident").to_numpy()
        key, copies, home = (rows.column(c).to_numpy() for c in ("key", "copies", "home"))
        order = np.argsort(key, kind="stable")
        visitors, homes = order[~resident[order]], order[resident[order]]
        if not len(visitors) or not len(homes):
            return pa.table({c: pa.array([], pa.int64()) for c in ("key", "links", "root")})
        x = unit(_matrix(rows.column("vector").combine_chunks(), dim))
        x, y = x[visitors], x[homes]
        kx, ky, wx, wy = key[visitors], key[homes], copies[visitors], copies[homes]
        keys = np.unique(np.concatenate([kx, ky]))
        px, py = np.searchsorted(keys, kx), np.searchsorted(keys, ky)
        visits = rows.column("visits").combine_chunks().take(pa.array(homes))
        seen = visits.flatten().to_numpy().reshape(len(homes), -1)
        links, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for a in range(0, len(x), 512):
            near = x[a : a + 512] @ y.T >= least
            near &= kx[a : a + 512, None] != ky[None, :]
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                hit, i = np.flatnonzero(near[r]), a + r
                links[px[i]] += wy[hit].sum()
                # A resident that doesn't visit this visitor's home won't find the link itself.
                blind = hit[~(seen[hit] == home[visitors[i]]).any(axis=1)]
                links[py[blind]] += wx[i]
                met = np.unique(np.append(label[py[hit]], label[px[i]]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        found = np.flatnonzero((links > 0) | (label != np.arange(len(keys))))
        return pa.table({"key": keys[found], "links": links[found], "root": keys[label[found]]})

    return run


def _met(classes: DataFrame, grid: Grid, probe: np.ndarray, least: float, most: int, dim: int) -> np.ndarray:
    """How many true neighbours each probe meets at each place, at ``most`` those it never meets; its own class is left out."""
    sent = classes.sparkSession.sparkContext.broadcast((grid, probe, grid.visits(probe, most)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, probe, sequence = sent.value
        for batch in batches:
            y = unit(_matrix(batch.column("vector"), dim))
            for a in range(0, len(y), 1024):
                part = y[a : a + 1024]
                i, j = np.nonzero(probe @ part.T >= least)
                # Classes are distinct vectors: only the probe's own, up to its length, is equal to it.
                other = np.abs(probe[i] - part[j]).max(axis=1, initial=0) > 1e-12
                i, j = i[other], j[other]
                hit = sequence[i] == grid.visits(part, 1)[:, 0][j][:, None]
                place = np.where(hit.any(axis=1), hit.argmax(axis=1), most)
                key, n = np.unique(i * (most + 1) + place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    rows = classes.select("vector").mapInArrow(meet, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(probe), most + 1))
    out.ravel()[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    return out


def calibrate(classes: DataFrame, sample: np.ndarray, grid: Grid, least: float, target: float, dim: int, probes: int = 512, least_known: int = 200, first_visits: int = 256) -> dict:
    """{"visits", "recall", "probes"}: the least number of visits that reaches ``target``, the recall measured for it and by how many probes.

    ``probes`` is 0 where too few vectors had a neighbour and stand-ins were measured.
    """
    drawn = np.random.default_rng(3).permutation(len(sample))[: 8 * probes]
    most = min(first_visits, grid.cells)
    while True:
        share, known, at, size = np.zeros(most + 1), 0, 0, probes
        while at < len(drawn) and known < least_known:
            found = _met(classes, grid, unit(sample[drawn[at : at + size]]), least, most, dim)
            found = found[found.sum(axis=1) > 0]
            share += (found / np.maximum(found.sum(axis=1, keepdims=True), 1)).sum(axis=0)
            known, at, size = known + len(found), at + size, size * 4
        if known < least_known:
            known = 0
            x = unit(np.tile(sample, (-(-2000 // len(sample)), 1))[:20_000])
            share = np.bincount(grid.places(x, at_cosine(x, least), most), minlength=most + 1).astype(float)
        recall = np.cumsum(share[:most]) / max(share.sum(), 1e-300)
        visits = int(min(max(4, np.searchsorted(recall, target - 1e-9) + 1), most))
        if recall[visits - 1] >= target - 1e-9 or most == grid.cells:
            return {"visits": visits, "recall": float(recall[visits - 1]), "probes": known}
        most = min(2 * most, grid.cells)


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    vector_id: str = "vec_id",
    column: str = "embedding",
    target_recall: float = 0.995,
    sample_rows: int = 20_000,
    per_cell: int = 512,
    most_centroids: int = 1024,
    block: int = 4096,
    measured: dict | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; the codebooks are fitted on at most ``sample_rows`` vectors.

    ``measured``, if given, receives what ``calibrate`` found.
    """
    spark = vectors.sparkSession
    prepare(spark)
    raw = F.col(column)
    fine = raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(raw, lambda v: v != 0)
    rows = vectors.select(F.col(vector_id).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), raw).alias("_vector")).withColumn("key", F.xxhash64("_vector"))
    classes = rows.where(F.col("_vector").isNotNull()).groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("_vector").alias("vector"))
    classes = materialise(classes)
    count, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    sample = classes.orderBy(F.xxhash64("key", F.lit(1))).limit(sample_rows).select("vector").toArrow().column(0).combine_chunks()
    sample = _matrix(sample, dim) if len(sample) else np.ones((1, dim))
    k = int(min(most_centroids, max(2, np.ceil(np.sqrt(count / per_cell))), len(sample)))
    grid = Grid.fit(sample, k)
    plan = calibrate(classes, sample, grid, least, target_recall, dim)
    visits = plan["visits"]
    if measured is not None:
        measured.update(plan)
    sent = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = sent.value
        for batch in batches:
            x = unit(_matrix(batch.column("vector"), dim))
            if not len(x):
                continue
            seen = grid.visits(x, visits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * seen.shape[1], pa.int32()), pa.array(seen.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "copies", "vector")), pa.array(seen[:, 0]), lists], ["key", "copies", "vector", "home", "visits"])

    kind = classes.schema["vector"].dataType.simpleString()
    placed = classes.select("key", "copies", "vector").mapInArrow(place, f"key long, copies long, vector {kind}, home long, visits array<long>")
    if dim > 1:
        pad = F.expr(f"transform(sequence(0, {dim - 1}), i -> coalesce(get(vector, i), 0))")
        placed = placed.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(pad).cast(kind))
    placed = materialise(placed)
    # Blocks by cell: at most most_centroids ** 2 cells, which bounds this side.
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("vb"))
    residents = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("rb"))
    size = F.broadcast(visitors.join(residents, "cell"))
    base = placed.select("key", "copies", "vector", "home")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    came = placed.select("key", "copies", "vector", "home", F.explode("visits").alias("cell")).join(size, "cell").withColumn("v", F.pmod(F.xxhash64("key"), F.col("vb")).cast("int")).withColumn("r", spread(F.col("rb")))
    live = placed.join(size, placed.home == size.cell).withColumn("r", F.pmod(F.xxhash64("key", F.lit(2)), F.col("rb")).cast("int")).withColumn("v", spread(F.col("vb")))
    both = came.select("cell", "v", "r", *base.columns, F.lit(None).cast("array<long>").alias("visits"), F.lit(False).alias("resident")).unionByName(live.select("cell", "v", "r", *base.columns, "visits", F.lit(True).alias("resident")))
    found = materialise(both.groupBy("cell", "v", "r").applyInArrow(_verify(least, dim), "key long, links long, root long"))

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select("key", "root"), "key", "root").withColumnRenamed("id", "key")
    linked = classes.drop("vector").join(links, "key", "left").join(roots, "key", "left").where("copies > 1 or links is not null").withColumn("root", F.coalesce("root", "key"))
    linked = materialise(linked)
    names = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = materialise(linked.join(names, "root").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "copies"))
    # Classes of at least total / 20,000 rows are at most 20,000: a proven bound for the broadcast.
    hot_at = max(1000, int(vectors.count()) // 20_000)
    out = rows.join(F.broadcast(linked.where(F.col("copies") >= hot_at).drop("copies")).withColumnsRenamed({"n_links": "_n", "component_id": "_c"}), "key", "left")
    served = F.col("_n").isNotNull() | F.col("_vector").isNull()
    out = out.withColumn("key", F.when(served, F.xxhash64("vec_id", "key")).otherwise(F.col("key"))).withColumn("_open", ~served)
    small = linked.where(F.col("copies") < hot_at).drop("copies").withColumn("_open", F.lit(True))
    out = out.join(small, ["key", "_open"], "left")
    component = F.coalesce("_c", "component_id", "vec_id")
    return out.select("vec_id", F.coalesce("_n", "n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
