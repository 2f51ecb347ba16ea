"""The ``opN_`` queries: thin digests of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, language_id, line_dedup, lm_scoring, ngram_join, oracles, packing, quality_classifier, quality_rules, toxicity
from .runtime import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(n: int, remainder: int) -> Column:
    """Whether a row is held out; rows without an id are not, and are not learnt from either."""
    return F.coalesce(fold("doc_id", n) == remainder, F.lit(False)).alias("held_out")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_deleted", "deleted", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"), allowed=fold("doc_id", 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.train(docs, fold("doc_id", 4) != 2)
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", _held(4, 2), "lang_pred", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm_scoring.fit(docs.where(fold("doc_id", 5) != 1))
    scored = lm_scoring.score(docs, model, counts)
    return scored.select("doc_id", _held(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.annotate(docs).select("doc_id", *quality_rules.COLUMNS)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents")).drop("version", "group")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"), "quality", allowed=fold("doc_id", 5) != 0)
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_bpe": op1_bpe, "op2_line_dedup": op2_line_dedup, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_language_id": op5_language_id, "op6_lm_scoring": op6_lm_scoring, "op7_quality_rules": op7_quality_rules, "op8_embedding_dedup": op8_embedding_dedup, "op9_ngram_join": op9_ngram_join, "op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {"op7_quality_rules": oracles.RULES, "op8_embedding_dedup": oracles.NEAR_VECTORS, "op9_ngram_join": oracles.NGRAMS}
