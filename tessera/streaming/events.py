"""Windowed aggregation of events, and a streaming sink into a catalog table.

The same functions take batch and streaming DataFrames; with a watermark the
state of a stream is bounded by the lateness allowed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Catalog
from ..sources.config import WriteConfig
from ..sources.table import write_fragments


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, window: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",), ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """(start, end, keys, n, total) by tumbling or sliding window; ``late`` sets a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    made = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """(start, end, key, n): runs of events of a key with less than ``gap`` between neighbours."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    made = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def append_to(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str, config: WriteConfig | None = None) -> StreamingQuery:
    """Write every micro-batch as fragments of a table.

    The stream's id, which its checkpoint keeps over restarts, and the batch
    number are part of the fragments' ids, so a batch that runs again after a
    failure replaces itself, and nothing else: neither another stream into the
    table nor the same one with a new checkpoint loses rows.
    """
    schema, config = catalog.schema(table), config or WriteConfig()

    def store(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha256(checkpoint.encode()).hexdigest()[:32]
        prefix = f"batch-{own}-{number}-"
        new = write_fragments(catalog, rows, schema, config)
        for i, f in enumerate(new):
            f.id = f"{prefix}{i}"
        again = tuple(f.id for f in catalog.fragments(table) if f.id.startswith(prefix))
        if new or again:
            catalog.add_fragments(table, new, again)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
