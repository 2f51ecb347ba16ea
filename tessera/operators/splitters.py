"""Document splitters: DataFrame of documents in, DataFrame of chunks out.

Documents have ``doc_id`` and ``text`` and may have ``language``.  Chunk ids
are hashes of document, splitter, level and place, so a task that runs again
makes the same ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ((1024, "Small"), (512, "Medium"), (128, "Large"))
PIECE = 4096
ENDS = ".!?。！？;；"


@dataclass(frozen=True)
class SplitterConfig:
    max_chunk_size: int = 512
    overlap: int = 50
    preserve_metadata: bool = True
    language: str | None = None
    use_llm: bool = False
    params: dict = field(default_factory=dict)


def chunk_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]), 256).substr(1, 32)


def windows(text: Column, size: int) -> Column:
    """Consecutive windows of ``size`` characters; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one walk; substrings would count from the start again each time


def _chunks(docs: DataFrame, pieces: Column, splitter: str, granularity: str, hierarchy: Column | None = None, level: int = 0) -> DataFrame:
    spoken = F.coalesce("language", F.lit("unknown")) if "language" in docs.columns else F.lit("unknown")
    # One row from the outer explode: it makes the pieces a column, computed once.
    own = docs.select("doc_id", spoken.alias("_language"), F.explode(F.array(pieces)).alias("_p"))
    rows = own.select("doc_id", F.col("_language").alias("language"), F.size("_p").alias("total_chunks"), F.posexplode("_p").alias("chunk_index", "content"))
    return rows.select(
        chunk_id(F.col("doc_id"), splitter, F.lit(level), F.col("chunk_index")).alias("id"),
        "doc_id",
        "content",
        F.lit(level).alias("level"),
        (hierarchy if hierarchy is not None else F.array().cast("array<string>")).alias("section_hierarchy"),
        "chunk_index",
        "total_chunks",
        F.lit(granularity).alias("granularity"),
        "language",
    )


class Splitter:
    """Contract: a name, a config and ``split``."""

    name = ""

    def __init__(self, config: SplitterConfig | None = None):
        self.config = config or SplitterConfig()

    def split(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError


class HierarchicalSplitter(Splitter):
    """Fixed windows of 1024, 512 and 128 characters; an overlap is not used.

    All levels come from one pass over the texts.
    """

    name = "hierarchical"

    def split(self, docs: DataFrame) -> DataFrame:
        levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(label).alias("granularity"), windows(F.col("text"), size).alias("pieces")) for i, (size, label) in enumerate(LEVELS)])
        language = F.coalesce("language", F.lit("unknown")) if "language" in docs.columns else F.lit("unknown")
        rows = docs.select("doc_id", language.alias("language"), F.explode(levels).alias("l"))
        rows = rows.select("doc_id", "language", "l.level", "l.granularity", F.size("l.pieces").alias("total_chunks"), F.posexplode("l.pieces").alias("chunk_index", "content"))
        return rows.select(chunk_id(F.col("doc_id"), self.name, F.col("level"), F.col("chunk_index")).alias("id"), "doc_id", "content", "level", F.array(F.concat(F.lit("Level "), "level")).alias("section_hierarchy"), "chunk_index", "total_chunks", "granularity", "language")


def propositions(text: Column, language: Column) -> Column:
    """Sentence-like pieces: trimmed, ended by a full stop, longer than 8 characters, short neighbours merged.

    The merge is a left fold over the pieces: a buffer below 40 characters takes
    the next piece if that has fewer than 100.
    """
    stop = F.when(language.isin("zh", "cmn", "Mandarin"), F.lit("。")).otherwise(F.lit("."))
    pieces = F.transform(windows(text, PIECE), lambda p: F.regexp_replace(p, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    ended = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.when(F.locate(ENDS[0], F.right(p, F.lit(1))) > 0, p).when(F.right(p, F.lit(1)).isin(*ENDS), p).otherwise(F.concat(p, stop)))
    kept = F.filter(ended, lambda p: F.length(p) > 8)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))

    def step(acc: Column, p: Column) -> Column:
        buffer, done = acc["buffer"], acc["done"]
        joins = (F.length(buffer) < 40) & (F.length(p) < 100)
        return (
            F.when(buffer == "", F.struct(done.alias("done"), p.alias("buffer")))
            .when(joins, F.struct(done.alias("done"), F.concat(F.regexp_replace(buffer, "[.。]+$", ""), F.lit(" "), p).alias("buffer")))
            .otherwise(F.struct(F.concat(done, F.array(buffer)).alias("done"), p.alias("buffer")))
        )

    return F.aggregate(kept, start, step, lambda acc: F.when(acc["buffer"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buffer"]))))


class PropositionSplitter(Splitter):
    """Rule-based propositions; ``extractor`` may replace the rules for texts of 1500 bytes or more."""

    name = "proposition"

    def __init__(self, config: SplitterConfig | None = None, extractor: Callable[[Column], Column] | None = None):
        super().__init__(config)
        self.extractor = extractor

    def split(self, docs: DataFrame) -> DataFrame:
        language = F.coalesce("language", F.lit("unknown")) if "language" in docs.columns else F.lit("unknown")
        found = propositions(F.col("text"), language)
        if self.extractor is not None and self.config.use_llm:
            own = self.extractor(F.col("text"))
            found = F.when((F.octet_length("text") >= 1500) & (F.size(own) > 3), own).otherwise(found)
        chunks = _chunks(docs, found, self.name, "Small")
        return chunks.withColumn("custom_fields", F.create_map(F.lit("splitter"), F.lit(self.name), F.lit("is_atomic_fact"), F.lit("true"), F.lit("proposition_index"), F.col("chunk_index").cast("string")))


class AgenticSplitter(Splitter):
    """``planner`` maps a text column to an array of chunks; without one the text is one chunk."""

    name = "agentic"

    def __init__(self, config: SplitterConfig | None = None, planner: Callable[[Column], Column] | None = None):
        super().__init__(config)
        self.planner = planner or (lambda text: F.array(text))

    def split(self, docs: DataFrame) -> DataFrame:
        return _chunks(docs.where("text is not null"), self.planner(F.col("text")), self.name, "Medium")


class RerankSplitter(Splitter):
    """One chunk for the whole text."""

    name = "llm_rerank"

    def split(self, docs: DataFrame) -> DataFrame:
        return _chunks(docs.where("text is not null"), F.array("text"), self.name, "Medium")


SPLITTERS = {s.name: s for s in (PropositionSplitter, HierarchicalSplitter, RerankSplitter, AgenticSplitter)}


def create_splitter(kind: str, config: SplitterConfig | None = None) -> Splitter:
    if kind not in SPLITTERS:
        raise ValueError(f"unknown splitter: {kind}")
    return SPLITTERS[kind](config)
