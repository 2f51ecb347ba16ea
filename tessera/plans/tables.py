"""Opening the tables of a folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_schemas: dict[tuple[str, int], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  The schema of an unchanged local file is read once: inferring it is a job of its own."""
    path = f"{sf_dir}/{name}.parquet"
    if not os.path.isfile(path):
        return spark.read.parquet(path)
    key = (os.path.realpath(path), os.stat(path).st_mtime_ns)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def run_sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """``query`` over the folder's tables.  Only the tables it names are opened, as temporary views."""
    words = set(query.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name in NAMES:
        if name in words:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(query)
