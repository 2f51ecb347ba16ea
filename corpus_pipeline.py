"""The corpus pipeline: classify, filter, dedup lines, dedup near copies, pack.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the next documents, the last one the packed pieces.  ``run``
writes every stage's result to the shared folder and reads it for the next, so
a lost executor costs the running stage only.

All stages but the last return the columns they got, with the same types and
in the same order; columns that the operators use inside stand apart from
them, so a column of any name passes through unchanged (``text`` and ``n_chars``
change where lines are cut).  Edge cases, for every stage: an empty table gives
an empty table; a row without an id is judged by its own text, never drops
another and is packed like others; repeated rows are judged one by one alike
(line dedup takes them for one document, of which near dedup leaves one row);
ties go to the smallest id, then to the hash of the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from tessera.llm.components import components
from tessera.llm.runtime import drop_materialised, drop_shuffles, fold, materialise

#: No SQL: a trained model, an alignment and a packing search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all other columns in one struct, where no name of theirs can clash."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def _together(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return made.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null, empty or blank text has no indicator and the score of the intercept;
    a very long one is read whole; without labels nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels, "quality", allowed=fold("doc_id", 5) != 0)
    return _together(quality_classifier.score(_apart(docs), model).where("score >= 0.3"), docs)


def filter_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cascade; null and empty texts fail it."""
    return _together(quality_rules.annotate(_apart(docs)).where("kept"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines of earlier ones.

    A document that loses lines and is left with fewer words than a block must
    have (8) goes; others stay, null and empty texts too.  ``n_chars``, if there, is counted again.
    """
    cut = line_dedup.dedup(_apart(docs), min_words=8)
    words = F.regexp_count(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"))
    left = _together(cut.where((F.col("n_deleted") == 0) | (words >= 8)), docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of similar ones among ``docs``.

    Two documents are linked if they are similar now, or were before lines were
    cut (texts found by id in ``documents``): what is left of a near copy once
    common lines are gone no longer resembles its original, and what is left of
    others may be alike only then.  Where ids are missing or repeated, or a
    document is not found there, only the texts as they are now are compared.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = docs.select("doc_id")
    if source.schema["doc_id"].dataType == docs.schema["doc_id"].dataType:
        known = source.select("doc_id").groupBy("doc_id").count()
        found = ids.groupBy("doc_id").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
        odd = found.where(F.col("doc_id").isNull() | (F.col("n") > 1) | F.col("count").isNull() | (F.col("count") > 1)).limit(1).count()
        if not odd:
            # Written once: the join below reads the texts twice.
            before = materialise(source.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
            links = _links(before)
            drop_materialised(before)
            # Else both comparisons have their shuffle files on disk at once.
            drop_shuffles(spark)
            links = links.unionByName(_links(docs))
            gone = components(links, "doc_id", "component_id").where("id != root").select(F.col("id").alias("doc_id"))
            return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return ngram_join.one_of_each(docs, ngram_join.similar(docs))


def _links(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the documents that have a smaller one in their component."""
    return materialise(ngram_join.similar(docs).where("doc_id != component_id").select("doc_id", "component_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as packed pieces; a null or empty text is one piece with the end id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", filter_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
