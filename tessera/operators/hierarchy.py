"""Parents and children of chunks: containment of texts within a document.

Chunks meet the chunks of their own document only.  They are brought together
by one shuffle; parents, walks to the root and contexts of a document are then
told in one pass over its chunks, which go no further.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .worker import materialise, prepare


def potential_parents(chunks: DataFrame) -> DataFrame:
    """(doc_id, id, parent_id, score): every chunk of the document whose text contains the chunk's; score is the ratio of bytes."""
    own = chunks.select("doc_id", "id", "content", F.octet_length("content").alias("n"))
    other = own.select(F.col("doc_id").alias("_d"), F.col("id").alias("parent_id"), F.col("content").alias("_c"), F.col("n").alias("_n"))
    met = own.join(other, (F.col("doc_id") == F.col("_d")) & (F.col("n") <= F.col("_n")) & F.col("_c").contains(F.col("content")))
    return met.select("doc_id", "id", "parent_id", (F.col("n") / F.col("_n")).alias("score"))


def parents_of(ids: list, contents: list[bytes | None], places: list) -> dict:
    """id -> parent among the chunks of one document: of those after it by (bytes, place) that contain it, the smallest.

    The contents stand in this order in one string, apart by a byte that no
    text has; the first find after a chunk's own end is its parent.
    """
    order = sorted((i for i, c in enumerate(contents) if c is not None and places[i] is not None), key=lambda i: (len(contents[i]), places[i]))
    whole = b"\xff".join(contents[i] for i in order)
    starts, at = [], 0
    for i in order:
        starts.append(at)
        at += len(contents[i]) + 1
    found: dict = {}
    for k, i in enumerate(order):
        n = k + 1
        # Only in a document that is there twice do chunks have the same size and place: these are not after each other.
        while n < len(order) and len(contents[order[n]]) == len(contents[i]) and places[order[n]] == places[i]:
            n += 1
        spot = whole.find(contents[i], starts[n]) if n < len(order) else -1
        if spot >= 0:
            j = order[bisect_right(starts, spot) - 1]
            best = (len(contents[j]), places[j])
            if ids[i] not in found or best < found[ids[i]][0]:
                found[ids[i]] = (best, ids[j])
    return {i: parent for i, (_, parent) in found.items()}


def by_document(chunks: DataFrame, made: Callable[[pa.Table, dict], pa.Table | pa.RecordBatch], schema: T.StructType, order: str) -> DataFrame:
    """``made`` of every document's chunks and their parents, in one pass; a chunk without a document has no parent."""
    prepare(chunks.sparkSession)
    together = chunks.repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[pa.RecordBatch], known: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            ids = rows.column("id").to_pylist()
            parent = parents_of(ids, rows.column("content").cast(pa.binary()).to_pylist(), rows.column(order).to_pylist()) if known else {}
            yield from made(rows, parent).combine_chunks().to_batches()

        def documents() -> Iterator[pa.Table]:
            held, last = [], None
            for batch in batches:
                docs = batch.column("doc_id").to_pylist()
                a = 0
                while a < len(docs):
                    b = a + 1
                    while b < len(docs) and docs[b] == docs[a]:
                        b += 1
                    if held and docs[a] != last:
                        yield from close(held, last is not None)
                        held = []
                    held.append(batch.slice(a, b - a))
                    last, a = docs[a], b
                    if last is None:  # such chunks never meet
                        yield from close(held, False)
                        held = []
            if held:
                yield from close(held, last is not None)

        waiting, rows = [], 0
        for part in documents():
            waiting.append(part)
            rows += part.num_rows
            if rows >= 5000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return together.mapInArrow(run, schema)


def with_parents(chunks: DataFrame, order: str = "position", name: str = "parent_id") -> DataFrame:
    """``chunks`` with the parent of each; null for roots."""
    field = T.StructField(name, chunks.schema["id"].dataType)

    def made(rows: pa.Table, parent: dict) -> pa.Table:
        return rows.append_column(name, pa.array([parent.get(i) for i in rows.column("id").to_pylist()], rows.schema.field("id").type))

    return by_document(chunks, made, T.StructType([*chunks.schema.fields, field]), order)


def assign_parents(chunks: DataFrame, order: str = "position") -> DataFrame:
    """(doc_id, id, parent_id): among the chunks after it by (bytes, position) that contain it, the smallest; null for roots.

    ``position`` is the chunk's place in its document's list.
    """
    own = chunks.select("doc_id", "id", "content", order)

    def made(rows: pa.Table, parent: dict) -> pa.Table:
        kind = rows.schema.field("id").type
        return rows.select(["doc_id", "id"]).append_column("parent_id", pa.array([parent.get(i) for i in rows.column("id").to_pylist()], kind))

    fields = [own.schema["doc_id"], own.schema["id"], T.StructField("parent_id", own.schema["id"].dataType)]
    return by_document(own, made, T.StructType(fields), order)


def steps(parent: dict, start) -> list:
    """Ancestors of a chunk, the nearest first; on a cycle each once."""
    met, now = [], parent.get(start)
    seen = set()
    while now is not None and now not in seen:
        met.append(now)
        seen.add(now)
        now = parent.get(now)
    return met


def chunk_ancestors(chunks: DataFrame, order: str = "position") -> DataFrame:
    """(id, ancestor, depth) of chunks, as ``ancestors`` of their parents, in the same pass."""
    own = chunks.select("doc_id", "id", "content", order)

    def made(rows: pa.Table, parent: dict) -> pa.Table:
        kind = rows.schema.field("id").type
        walks = [(i, a, k + 1) for i in parent for k, a in enumerate(steps(parent, i))]
        return pa.table([pa.array([w[0] for w in walks], kind), pa.array([w[1] for w in walks], kind), pa.array([w[2] for w in walks], pa.int32())], ["id", "ancestor", "depth"])

    kind = own.schema["id"].dataType
    return by_document(own, made, T.StructType([T.StructField("id", kind), T.StructField("ancestor", kind), T.StructField("depth", T.IntegerType())]), order)


def chunk_depths(chunks: DataFrame, order: str = "position") -> DataFrame:
    """(id, depth) of chunks, as ``depths`` of their parents, in the same pass."""
    own = chunks.select("doc_id", "id", "content", order)

    def made(rows: pa.Table, parent: dict) -> pa.Table:
        return pa.table([rows.column("id"), pa.array([len(steps(parent, i)) for i in rows.column("id").to_pylist()], pa.int32())], ["id", "depth"])

    return by_document(own, made, T.StructType([own.schema["id"], T.StructField("depth", T.IntegerType())]), order)


def chunk_context(chunks: DataFrame, order: str = "position") -> DataFrame:
    """(id, context) of chunks, as ``context`` with their parents, in the same pass."""
    own = chunks.select("doc_id", "id", "content", order)

    def made(rows: pa.Table, parent: dict) -> pa.Table:
        ids, contents = rows.column("id").to_pylist(), rows.column("content").to_pylist()
        text, number = dict(zip(ids, contents)), {}
        for p in parent.values():
            number[p] = number.get(p, 0) + 1
        out = []
        for i, content in zip(ids, contents):
            lines = [f"Parent context: {text[parent[i]][:200]}"] if i in parent else []
            lines += [f"Child chunks: {number[i]}"] if i in number else []
            out.append("\n".join(lines) + f"\n\n{content}" if lines and content is not None else content)
        return pa.table([rows.column("id"), pa.array(out, rows.schema.field("content").type)], ["id", "context"])

    return by_document(own, made, T.StructType([own.schema["id"], T.StructField("context", T.StringType())]), order)


def children(edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent_id") == parent).select("id")


def ancestors(edges: DataFrame) -> DataFrame:
    """(id, ancestor, depth) by doubling joins, until a round finds no new pair; an id has one parent.

    On a cycle each id is met once, itself too.
    """
    known = materialise(edges.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth")))
    closed = lambda pairs: pairs.where(F.col("id") == F.col("ancestor")).limit(1).count() > 0
    reach, cyclic = 1, closed(known)
    while True:
        step = known.where(F.col("depth") == reach).select(F.col("id").alias("_i"), F.col("ancestor").alias("_a"))
        if not step.limit(1).count():
            return known
        onward = known.select(F.col("id").alias("_b"), F.col("ancestor").alias("_c"), F.col("depth").alias("_k"))
        further = materialise(step.join(onward, F.col("_a") == F.col("_b")).select(F.col("_i").alias("id"), F.col("_c").alias("ancestor"), (F.col("_k") + reach).alias("depth")))
        # A pair is met again only past a cycle, which some id closes by then; such pairs would go round for ever.
        cyclic = cyclic or closed(further)
        if cyclic:
            further = materialise(further.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        known = known.unionByName(further)
        reach *= 2


def descendants(edges: DataFrame, root: str) -> DataFrame:
    if "doc_id" in edges.columns:  # parents are in the same document
        there = [r[0] for r in edges.where(F.col("parent_id") == root).select("doc_id").distinct().collect()]
        edges = edges.where(F.col("doc_id").isin(there))
    return ancestors(edges).where(F.col("ancestor") == root).select("id", "depth")


def depths(edges: DataFrame) -> DataFrame:
    """(id, depth): steps to the root."""
    far = ancestors(edges).groupBy("id").agg(F.max("depth").alias("depth"))
    return edges.select("id").join(far, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def context(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, context): the parent's first 200 characters, the number of children, and the chunk."""
    number = edges.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    parent = chunks.select(F.col("id").alias("parent_id"), F.substring("content", 1, 200).alias("_head"))
    rows = chunks.select("id", "content").join(edges.select("id", "parent_id"), "id").join(parent, "parent_id", "left").join(number, "id", "left")
    lines = F.array(F.concat(F.lit("Parent context: "), "_head"), F.concat(F.lit("Child chunks: "), F.col("children").cast("string")))
    head = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    return rows.select("id", F.when(head == "", F.col("content")).otherwise(F.concat(head, F.lit("\n\n"), "content")).alias("context"))


def grouped(chunks: DataFrame, order: str = "position") -> DataFrame:
    """(doc_id, position, id): chunks of each document in order."""
    place = Window.partitionBy("doc_id").orderBy(order, "id")
    return chunks.select("doc_id", (F.row_number().over(place) - 1).alias("place"), "id")
