"""Ingestion: split, relate, embed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import with_parents
from .splitters import Splitter

EMBEDDING = 384


def mock_embedding(text: Column, dim: int = EMBEDDING) -> Column:
    """``dim`` values tanh(bytes * sin(i) * 0.01); a stand-in for a model, kept in the JVM."""
    n = F.octet_length(text)
    waves = F.array(*[F.sin(F.lit(float(i))) for i in range(dim)])  # the same for every text: folded once
    return F.transform(waves, lambda wave: F.tanh(n * wave * 0.01).cast("float"))


@dataclass
class Pipeline:
    """``run`` maps documents to chunks with parents and embeddings; lazy, one plan.

    ``embed`` maps a text column to a vector column: an expression or a pandas UDF (batched by Arrow).
    """

    splitter: Splitter
    embed: Callable[[Column], Column] | None = None
    hierarchy: bool = False

    def run(self, docs: DataFrame) -> DataFrame:
        chunks = self.splitter.split(docs)
        if self.hierarchy:
            placed = chunks.withColumn("position", F.col("level") * F.lit(1 << 20) + F.col("chunk_index"))
            chunks = with_parents(placed, name="parent_chunk_id").drop("position")
        if self.embed is not None:
            chunks = chunks.withColumn("embedding", self.embed(F.col("content")))
        return chunks


class PipelineBuilder:
    """Collects the parts; a splitter is required."""

    def __init__(self):
        self._splitter: Splitter | None = None
        self._embed: Callable[[Column], Column] | None = None
        self._hierarchy = False

    def splitter(self, splitter: Splitter) -> "PipelineBuilder":
        self._splitter = splitter
        return self

    def embedder(self, embed: Callable[[Column], Column]) -> "PipelineBuilder":
        self._embed = embed
        return self

    def hierarchy(self, on: bool = True) -> "PipelineBuilder":
        self._hierarchy = on
        return self

    def build(self) -> Pipeline:
        if self._splitter is None:
            raise ValueError("a splitter is required")
        return Pipeline(self._splitter, self._embed, self._hierarchy)
