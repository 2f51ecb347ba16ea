"""Connected components of an edge table, by alternating star contractions.

Every round is two shuffles over the edges with combined minima; the table is
cut from its lineage by writing it to the shared folder.  No task sees a whole
component: a hot vertex is only a grouping key of minima, and the neighbours of
a vertex are joined with its minimum, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_materialised, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id reachable from each vertex of the edge table ``a``-``b``.

    Loops, repeated and reversed edges are allowed, rows with a null end are
    ignored; vertices without edges do not appear; no edges give an empty table.
    """
    flat = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = flat.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now)
    seen = None
    while True:
        # Large star: neighbours above a vertex go to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: neighbours below a vertex, and itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = materialise(small)
        state = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        drop_materialised(now)
        now = after
        if state == seen or not state[0]:
            break
        seen = state
    pairs = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("id"), "root").distinct())
