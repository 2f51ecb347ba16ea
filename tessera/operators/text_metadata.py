"""Metadata of documents: title, keywords, sections, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def title(text: Column, given: Column | None = None) -> Column:
    """``given``; else the first of five lines that is not blank, no heading and below 100 bytes; else the first ``# `` heading."""
    lines = F.transform(F.split(text, "\n"), _trim)
    plain = F.get(F.filter(F.slice(lines, 1, 5), lambda x: (x != "") & ~x.startswith("#") & (F.octet_length(x) < 100)), F.lit(0))
    heading = F.get(F.transform(F.filter(lines, lambda x: x.startswith("# ")), lambda x: _trim(F.substring(x, F.lit(3), F.length(x)))), F.lit(0))
    found = [plain, heading]
    return F.coalesce(*([given] if given is not None else []), *found)


def sections(text: Column) -> Column:
    """Headings of up to three marks, in order of lines."""
    lines = F.transform(F.split(text, "\n"), _trim)
    return F.transform(F.filter(lines, lambda x: x.rlike("^#{1,3} ")), lambda x: _trim(F.regexp_replace(x, "^#{1,3} ", "")))


def underlined(text: Column) -> Column:
    """Lines followed by a line of three or more ``=`` or ``-`` only."""
    lines = F.transform(F.split(text, "\n"), _trim)
    below = F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit("")))
    pairs = F.filter(F.arrays_zip(lines.alias("a"), below.alias("b")), lambda p: (p["a"] != "") & p["b"].rlike("^(={3,}|-{3,})$"))
    return F.transform(pairs, lambda p: p["a"])


#: Unicode blanks, listed: faster than the flag that gives \\s this meaning.
BLANKS = "[\\s\\x0b\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def word_array(text: Column) -> Column:
    """Words between Unicode blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def keywords(docs: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, word, count, rank): the most frequent long words, ties by word.

    Words are counted within a document before anything is shuffled by word.
    """
    words = F.filter(word_array(F.col("text")), lambda w: F.octet_length(w) > 4)
    clean = F.filter(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")), lambda w: w != "")
    counted = docs.select("doc_id", F.explode(clean).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("count"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def language(given: Column | None) -> Column:
    return F.coalesce(given, F.lit("en")) if given is not None else F.lit("en")


def chunk_metadata(docs: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, metadata struct): title, sections, keywords, language; the summary is left to a model."""
    words = keywords(docs, n).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("k"))
    base = docs.select("doc_id", title(F.col("text")).alias("title"), F.concat(sections(F.col("text")), underlined(F.col("text"))).alias("section_hierarchy"), language(F.col("lang") if "lang" in docs.columns else None).alias("language"))
    keyed = base.join(words, "doc_id", "left")
    empty = F.array().cast("array<string>")
    return keyed.select("doc_id", F.struct("title", "section_hierarchy", F.coalesce(F.transform("k", lambda x: x["word"]), empty).alias("keywords"), F.lit(None).cast("string").alias("summary"), "language").alias("metadata"))
