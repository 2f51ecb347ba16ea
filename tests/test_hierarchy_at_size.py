"""Chunks of documents are related in one pass after one shuffle."""

import random

from pyspark.sql import functions as F

from tessera.operators import hierarchy


def rows(spark):
    rng, out = random.Random(3), []
    for doc in [*range(40), None]:
        for p in range(rng.randrange(1, 25)):
            text = "".join(rng.choice("abé") for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 5))))
            out.append((doc, f"{doc}-{p}", None if p == 20 else text, p))
    return out, spark.createDataFrame(out, "doc_id long, id string, content string, position long").repartition(3)


def brute(out):
    parent = {}
    for d, i, c, p in out:
        met = [(len(y.encode()), q, j) for e, j, y, q in out if d is not None and e == d and None not in (c, y) and c in y and (len(y.encode()), q) > (len(c.encode()), p)]
        parent[i] = min(met)[2] if met else None
    return parent


def test_one_pass_equals_brute_force(spark):
    out, chunks = rows(spark)
    parent = brute(out)
    edges = hierarchy.assign_parents(chunks)
    assert {(r.id, r.parent_id) for r in edges.collect()} == set(parent.items())
    assert {(r.id, r.up, r.content, r.position) for r in hierarchy.with_parents(chunks, name="up").collect()} == {(i, parent[i], c, p) for _, i, c, p in out}
    pairs = lambda x: sorted(tuple(r) for r in x.collect())
    assert pairs(hierarchy.chunk_ancestors(chunks)) == pairs(hierarchy.ancestors(edges))
    assert pairs(hierarchy.chunk_depths(chunks)) == pairs(hierarchy.depths(edges))
    text = chunks.where("content is not null")  # a missing text has a missing context in either way
    assert pairs(hierarchy.chunk_context(text)) == pairs(hierarchy.context(text, hierarchy.assign_parents(text)))
    root = edges.agg(F.min("parent_id")).first()[0]
    assert pairs(hierarchy.descendants(edges, root)) == pairs(hierarchy.ancestors(edges.drop("doc_id")).where(F.col("ancestor") == root).select("id", "depth"))


def test_texts_are_shuffled_once(spark):
    """Contents used to meet by a join of all chunks with all chunks, and by more joins after it."""
    _, chunks = rows(spark)
    for made in (hierarchy.assign_parents, hierarchy.with_parents, hierarchy.chunk_ancestors, hierarchy.chunk_depths, hierarchy.chunk_context):
        plan = made(spark.createDataFrame(chunks.limit(9).collect(), chunks.schema))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
