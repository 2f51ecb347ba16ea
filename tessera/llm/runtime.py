"""Session helpers shared by the operators: worker environment, shared folder, folds."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep their linear algebra on one thread each."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        env.setdefault(name, "1")


def give_back() -> None:
    """Return memory that is free inside this process to the system: workers are kept and used again, several an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches that gives memory back at its end: a kept worker waits for its next task beside a busy JVM."""

    @functools.wraps(run)
    def lean_run(batches):
        yield from run(batches)
        give_back()

    return lean_run


def lean_group(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same for a function of large groups."""

    @functools.wraps(run)
    def lean_run(rows):
        made = run(rows)
        give_back()
        return made

    return lean_run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; where it is unset a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (local := path.removeprefix("file://")).startswith("/"):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files under a table made by ``materialise`` once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    jvm = spark.sparkContext._jvm
    for place in {os.path.dirname(f) for f in df.inputFiles()}:
        if root in place:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: it does so when their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def widened(schema: T.StructType, **added: str) -> T.StructType:
    """``schema`` with further fields (name = type)."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items())])


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % n
