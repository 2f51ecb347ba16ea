"""Secondary indexes: inverted, bitmap and range, combined filters and hybrid search.

An index is a DataFrame; terms are found by equality, so on a stored index
Parquet statistics and dictionary pages prune what a search does not need.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .knn import nearest
from .text_metadata import word_array


def text_terms(rows: DataFrame, doc_id: str, column: str) -> DataFrame:
    """(term, doc_id): lower-cased words between Unicode blanks, each once for a row."""
    words = word_array(F.lower(F.col(column)))
    return rows.select(F.explode(F.array_distinct(words)).alias("term"), F.col(doc_id).alias("doc_id"))


@dataclass
class InvertedIndex:
    """Postings (term, doc_id).

    Where documents are repeated a pair may be there more than once; every search gives a document once.
    """

    postings: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "InvertedIndex":
        return cls(spark.createDataFrame([], "term string, doc_id long"))

    def save(self, path: str) -> None:
        """In segments, one for each part of the texts, each sorted by term: nothing is shuffled, and statistics of pages prune what a search does not need."""
        self.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.page.row.count.limit", "20000").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "InvertedIndex":
        return cls(spark.read.parquet(path))

    def add_text(self, rows: DataFrame, doc_id: str, column: str) -> "InvertedIndex":
        """With the words of further texts."""
        return self.add(text_terms(rows, doc_id, column))

    def add(self, more: DataFrame) -> "InvertedIndex":
        return InvertedIndex(self.postings.unionByName(more.select("term", "doc_id")))

    def remove(self, gone: DataFrame) -> "InvertedIndex":
        """Without these (term, doc_id) pairs."""
        return InvertedIndex(self.postings.join(gone, ["term", "doc_id"], "left_anti"))

    def get(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id").distinct()

    def search_any(self, terms: Sequence[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(list(terms))).select("doc_id").distinct()

    def search_all(self, terms: Sequence[str]) -> DataFrame:
        """Documents with every term; no terms find nothing."""
        wanted = sorted(set(terms))
        hits = self.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
        return hits.where((F.col("n") == len(wanted)) & F.lit(bool(wanted))).select("doc_id")


@dataclass
class BitmapIndex:
    """Bit sets of document numbers by value, one row for each value and bucket of bits."""

    bitmaps: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, column: str, doc_id: str) -> "BitmapIndex":
        made = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"), F.bitmap_bucket_number(F.col(doc_id)).alias("bucket"))
        return cls(made.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(doc_id))).alias("bits")))

    def _bits(self, rows: DataFrame) -> DataFrame:
        keyed = rows.groupBy("value", F.bitmap_bucket_number("doc_id").alias("bucket"))
        return keyed.agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))

    def add(self, more: DataFrame) -> "BitmapIndex":
        """With further (value, doc_id) rows; bits that are set stay set."""
        both = self.bitmaps.unionByName(self._bits(more.where(F.col("value").isNotNull())))
        return BitmapIndex(both.groupBy("value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))

    def remove(self, gone: DataFrame) -> "BitmapIndex":
        """Without these (value, doc_id) rows: only bit maps of their values and buckets are taken apart."""
        touched = gone.select("value", F.bitmap_bucket_number("doc_id").alias("bucket")).distinct()
        open_ = BitmapIndex(self.bitmaps.join(touched, ["value", "bucket"], "left_semi"))
        left = open_.pairs().join(gone.select("value", "doc_id"), ["value", "doc_id"], "left_anti")
        return BitmapIndex(self.bitmaps.join(touched, ["value", "bucket"], "left_anti").unionByName(self._bits(left)))

    def counts(self) -> DataFrame:
        return self.bitmaps.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n"))

    def count(self, value) -> DataFrame:
        return self.counts().where(F.col("value") == value)

    def documents(self, value) -> DataFrame:
        """Document numbers of a value, ascending when ordered by doc_id."""
        return BitmapIndex(self.bitmaps.where(F.col("value") == value)).pairs().select("doc_id")

    def pairs(self) -> DataFrame:
        """(value, doc_id) of every set bit."""
        per = 8 * 4096
        byte = F.explode(F.sequence(F.lit(0), F.length("bits") - 1))
        rows = self.bitmaps.select("value", "bucket", "bits", byte.alias("byte"))
        rows = rows.select("value", "bucket", "byte", F.conv(F.hex(F.substring("bits", F.col("byte") + 1, F.lit(1))), 16, 10).cast("int").alias("b")).where("b > 0")
        rows = rows.select("value", "bucket", "byte", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where(F.expr("shiftright(b, bit) & 1 = 1"))
        at = F.col("byte") * 8 + F.col("bit")
        # Buckets from 1 on hold positive numbers from 1; those up to 0 hold zero and negative ones, downwards.
        number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * per + at + 1).otherwise(F.col("bucket") * per - at)
        return rows.select("value", number.cast("long").alias("doc_id"))

    def contains(self, value, doc: int) -> bool:
        return self.documents(value).where(F.col("doc_id") == doc).limit(1).count() > 0


@dataclass
class RangeIndex:
    """(value, doc_id) kept in value order, so that ranges prune files and pages."""

    rows: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, column: str, doc_id: str) -> "RangeIndex":
        kept = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
        return cls(kept.select(F.col(column).alias("value"), F.col(doc_id).alias("doc_id")))

    def save(self, path: str) -> None:
        """Sorted by ranges over files."""
        self.rows.repartitionByRange("value", "doc_id").sortWithinPartitions("value", "doc_id").write.mode("overwrite").parquet(path)

    def query(self, low, high) -> DataFrame:
        """Documents with a value in [low, high]."""
        return self.rows.where(F.col("value").between(low, high)).select("value", "doc_id")

    def bounds(self) -> DataFrame:
        return self.rows.agg(F.min("value").alias("min"), F.max("value").alias("max"))


@dataclass
class MetadataIndex:
    """Text, categorical and numerical fields of one table."""

    texts: dict[str, InvertedIndex] = field(default_factory=dict)
    categories: dict[str, BitmapIndex] = field(default_factory=dict)
    ranges: dict[str, RangeIndex] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: DataFrame, doc_id: str, texts: Sequence[str] = (), categories: Sequence[str] = (), numbers: Sequence[str] = ()) -> "MetadataIndex":
        return cls(
            {c: InvertedIndex(text_terms(rows, doc_id, c)) for c in texts},
            {c: BitmapIndex.build(rows, c, doc_id) for c in categories},
            {c: RangeIndex.build(rows, c, doc_id) for c in numbers},
        )

    def text_search(self, name: str, query: str) -> DataFrame | None:
        """Documents with the whole lower-cased query as one term; None for an unknown field."""
        return self.texts[name].get(query.lower()) if name in self.texts else None

    def text_search_all(self, name: str, query: str) -> DataFrame | None:
        """Documents with every word of the query."""
        return self.texts[name].search_all(query.lower().split()) if name in self.texts else None

    def categorical_filter(self, name: str, value) -> DataFrame | None:
        return self.categories[name].documents(value) if name in self.categories else None

    def numerical_range(self, name: str, low, high) -> DataFrame | None:
        return self.ranges[name].query(low, high).select("doc_id") if name in self.ranges else None

    def combined_filter(self, filters: Sequence[tuple]) -> DataFrame | None:
        """Documents that pass every ("text", field, query), ("category", field, value) or ("range", field, low, high).

        No filters, or a field that is not known, find nothing (None).
        """
        found = None
        for kind, name, *rest in filters:
            part = {"text": self.text_search, "category": self.categorical_filter, "range": self.numerical_range}[kind](name, *rest)
            if part is None:
                return None
            found = part if found is None else found.join(part, "doc_id", "left_semi")
        return found


FILTER_THEN_SEARCH, SEARCH_THEN_FILTER, INTERLEAVED = "filter_then_search", "search_then_filter", "interleaved"


def hybrid_search(rows: DataFrame, condition, query: Sequence[float], k: int, strategy: str = FILTER_THEN_SEARCH, metric: str = "euclidean", doc_id: str = "vec_id", column: str = "embedding", over_fetch: int = 4) -> DataFrame:
    """(id, distance) of the ``k`` nearest among rows that satisfy ``condition``.

    ``filter_then_search`` is exact.  ``search_then_filter`` fetches ``over_fetch``
    times ``k`` first; ``interleaved`` doubles the fetch until ``k`` rows pass or all were seen.
    """
    if strategy == FILTER_THEN_SEARCH:
        return nearest(rows.where(condition), query, k, metric, doc_id, column)
    if strategy not in (SEARCH_THEN_FILTER, INTERLEAVED):
        raise ValueError(f"unknown strategy: {strategy}")
    passing = rows.where(condition).select(F.col(doc_id).alias("id"))
    fetch = k * over_fetch
    while True:
        found = nearest(rows, query, fetch, metric, doc_id, column).join(passing, "id", "left_semi").orderBy("distance", "id").limit(k)
        if strategy == SEARCH_THEN_FILTER or found.count() >= k or fetch >= rows.count():
            return found
        fetch *= 2
