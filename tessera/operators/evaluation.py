"""Quality of chunks and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_metadata import word_array


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two arrays without repetition; 0 when there are none."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 0.0).otherwise(common / union)


def internal_coherence(text: Column) -> Column:
    """Mean Jaccard of all pairs of sentences; 1 with fewer than two."""
    trimmed = F.transform(F.split(text, "[.!?]"), lambda s: F.regexp_replace(s, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    # Words as hashes: set operations on longs are faster than on strings.
    sets = F.transform(F.filter(trimmed, lambda s: s != ""), lambda s: F.array_distinct(F.transform(word_array(s), lambda w: F.xxhash64(w))))

    def mean(sets: Column) -> Column:
        n = F.size(sets)
        # For each sentence the overlaps with those after it.
        sums = F.transform(sets, lambda a, i: F.aggregate(F.slice(sets, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda t, b: t + jaccard(a, b)))
        return F.when(n < 2, 1.0).otherwise(F.aggregate(sums, F.lit(0.0), lambda t, x: t + x) / (n * (n - 1) / 2))

    # Bound as a lambda's argument, the sets are computed once for a text.
    return F.get(F.transform(F.array(sets), mean), F.lit(0))


def coherence(chunks: DataFrame, content: str = "content") -> DataFrame:
    """``chunks`` with internal, contextual, overall, topic and flow coherence."""
    inner = internal_coherence(F.col(content))
    return chunks.withColumn("internal", inner).withColumn("contextual", F.lit(0.0)).withColumn("overall", F.col("internal") / 2).withColumn("topic", F.col("internal") * 0.9).withColumn("flow", F.col("internal") * 0.8)


def pair_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(word_array(a)), F.array_distinct(word_array(b)))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank) by common words over the chunk's words.

    Chunks that share a word with a query are found by an equi-join on words,
    so queries never meet all chunks.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(word_array(F.lower("query")))).alias("word"))
    words = F.array_distinct(word_array(F.lower("content")))
    # The outer explode makes the words a column: else they would be split again for every exploded row.
    c = chunks.select("id", F.explode(F.array(words)).alias("_w")).select("id", F.size("_w").alias("n"), F.explode("_w").alias("word"))
    scored = c.join(F.broadcast(q) if _small(queries) else q, "word").groupBy("query_id", "id").agg((F.count("*") / F.first("n")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _small(queries: DataFrame, most: int = 10_000) -> bool:
    """Whether the queries are few enough to broadcast."""
    return queries.limit(most + 1).count() <= most


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, mrr) of ranked results against (query_id, id).

    Hits are counted over all that was retrieved; recall is over min(relevant, k), precision over min(retrieved, k).
    """
    hits = retrieved.join(relevant.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    per = hits.groupBy("query_id").agg(F.count("_hit").alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("wanted"))
    rows = per.join(wanted, "query_id", "full")
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.coalesce(F.col("hits") / F.least("wanted", F.lit(k)), zero).alias("recall"),
        F.coalesce(F.col("hits") / F.least("n", F.lit(k)), zero).alias("precision"),
        F.coalesce(1 / F.col("first"), zero).alias("mrr"),
    )


def query_alignment(query: Column, contents: Column, k: int) -> Column:
    """Mean over the first ``k`` contents of the share of the query's words in them."""
    q = F.array_distinct(word_array(F.lower(query)))
    first = F.slice(contents, 1, k)
    shares = F.transform(first, lambda c: F.size(F.array_intersect(q, F.array_distinct(word_array(F.lower(c))))) / F.greatest(F.size(q), F.lit(1)))
    return F.when(F.size(first) == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda t, x: t + x) / F.size(first))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over queries, and the share of queries with a recall above one half."""
    return metrics.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("mrr").alias("mrr"), F.avg((F.col("recall") > 0.5).cast("double")).alias("coverage"))


def chunk_report(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: mean coherence, mean and spread of sizes in bytes, consistency 1 / (1 + std / mean)."""
    rows = chunks.select((internal_coherence(F.col(content)) / 2).alias("c"), F.octet_length(content).alias("n"))
    made = rows.agg(F.count("*").alias("n_chunks"), F.avg("c").alias("coherence"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"))
    return made.withColumn("consistency", 1 / (1 + F.col("std_size") / F.col("mean_size")))


def recommendations(coherence: float, consistency: float, recall: float | None = None) -> list[str]:
    out = []
    if coherence < 0.7:
        out.append("Sentences of a chunk share few words: try smaller chunks or splits by meaning.")
    if coherence > 0.8:
        out.append("Chunks are coherent.")
    if consistency < 0.6:
        out.append("Chunk sizes vary much: set a size limit.")
    if recall is not None and recall < 0.6:
        out.append("Recall is low: overlap chunks or fetch more of them.")
    return out or ["No change needed."]


def improvement(base: float, now: float) -> float:
    """Percent; 0 without a positive base."""
    return (now - base) / base * 100 if base > 0 else 0.0
