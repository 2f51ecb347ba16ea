"""Column statistics of fragments, by one pass over all files and columns."""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.worker import prepare
from ..schema import orderable


def to_json(value: Any) -> Any:
    """A statistic as JSON; the column's type tells how to read it back."""
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, float) and not math.isfinite(value):
        return repr(value)
    return value


def from_json(value: Any, kind: T.DataType) -> Any:
    """The value of a stored statistic in its column's type."""
    if value is None:
        return None
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    return value


def _below(a: pa.Array, b: pa.Array) -> bool:
    """Whether any value of ``a`` is below its neighbour in ``b``, in Spark's order: NaN is above all others."""
    if pa.types.is_floating(a.type):
        x, y = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        return bool(((x < y) | (np.isnan(y) & ~np.isnan(x))).any())
    if pa.types.is_boolean(a.type):
        a, b = a.cast(pa.int8()), b.cast(pa.int8())
    return bool(pc.any(pc.less(a, b)).as_py())


def _ends(a: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Smallest and largest value, in Spark's order, as arrays of one."""
    if pa.types.is_floating(a.type):
        x = a.to_numpy(zero_copy_only=False)
        low = np.nanmin(x) if not np.isnan(x).all() else np.nan
        return pa.array([low], a.type), pa.array([x.max()], a.type)
    found = pc.min_max(a)
    return pa.array([found["min"].as_py()], a.type), pa.array([found["max"].as_py()], a.type)


class _Run:
    """Statistics of consecutive rows of a file."""

    def __init__(self, file: str, part: str, start: int, columns: list[str]):
        self.file, self.part, self.start, self.rows = file, part, start, 0
        self.nulls, self.below = dict.fromkeys(columns, 0), dict.fromkeys(columns, False)
        self.ends: dict[str, tuple[pa.Array, pa.Array, pa.Array, pa.Array]] = {}

    def add(self, batch: pa.RecordBatch, ordered: set[str]) -> None:
        self.rows += batch.num_rows
        for c in self.nulls:
            column = batch.column(c)
            self.nulls[c] += column.null_count
            if c not in ordered or column.null_count == len(column):
                continue
            own = column.drop_null()
            low, high = _ends(own)
            before = self.ends.get(c)
            first, last = own.take(pa.array([0])), own.take(pa.array([len(own) - 1]))
            self.below[c] |= _below(own.slice(1), own.slice(0, len(own) - 1)) or before is not None and _below(first, before[3])
            if before is not None:
                low, high, first = _ends(pa.concat_arrays([low, before[0]]))[0], _ends(pa.concat_arrays([high, before[1]]))[1], before[2]
            self.ends[c] = (low, high, first, last)

    def row(self, schema: pa.Schema, ordered: list[str]) -> pa.RecordBatch:
        names, made = ["_file", "_part", "_start", "_rows"], [pa.array([x]) for x in (self.file, self.part)] + [pa.array([x], pa.int64()) for x in (self.start, self.rows)]
        for c in self.nulls:
            names.append(f"nulls_{c}")
            made.append(pa.array([self.nulls[c]], pa.int64()))
        for c in ordered:
            names += [f"{x}_{c}" for x in ("min", "max", "first", "last", "below")]
            made += [*(self.ends.get(c) or [pa.nulls(1, schema.field(c).type)] * 4), pa.array([self.below[c]])]
        return pa.RecordBatch.from_arrays(made, names)


def run_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each run of rows that a task reads from a file (_file, its last two names, by _row): counts, ends of every column, and whether its order is broken.

    Rows stay where they are read; only these rows go further.
    """
    ordered = [c for c in columns if orderable(df.schema[c].dataType)]
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, file = batch.column("_row").to_numpy(), batch.column("_file")
            new = (at[1:] != at[:-1] + 1) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                above, name = f"/{file[a].as_py()}".rsplit("/", 2)[-2:]
                key = (above, name) if above.endswith(".parquet") else (name, "")  # a folder's files are x.parquet/part-...
                if now is None or key != (now.file, now.part) or int(at[a]) != now.start + now.rows:
                    if now is not None:
                        yield now.row(batch.schema, ordered)
                    now = _Run(*key, int(at[a]), columns)
                now.add(batch.slice(a, b - a), set(ordered))
            schema = batch.schema
        if now is not None:
            yield now.row(schema, ordered)

    fields = [T.StructField("_file", T.StringType()), T.StructField("_part", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("_start", "_rows", *(f"nulls_{c}" for c in columns)))]
    for c in ordered:
        fields += [T.StructField(f"{x}_{c}", df.schema[c].dataType) for x in ("min", "max", "first", "last")] + [T.StructField(f"below_{c}", T.BooleanType())]
    return df.mapInArrow(run, T.StructType(fields))


def fragment_stats(runs: DataFrame) -> DataFrame:
    """(_file, row_count, then nulls_, min_, max_ and sorted_ of every column) by fragment; sorted: no value is below the last one before it, nulls are skipped."""
    ordered = [c.removeprefix("below_") for c in runs.columns if c.startswith("below_")]
    before = Window.partitionBy("_file").orderBy("_part", "_start").rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.withColumns({f"below_{c}": F.col(f"below_{c}") | F.coalesce(F.col(f"first_{c}") < F.last(f"last_{c}", ignorenulls=True).over(before), F.lit(False)) for c in ordered})
    found = [F.sum("_rows").alias("row_count"), *(F.sum(c).alias(c) for c in runs.columns if c.startswith("nulls_"))]
    for c in ordered:
        found += [F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"), (F.count_if(f"below_{c}") == 0).alias(f"sorted_{c}")]
    return marked.groupBy("_file").agg(*found)


def of_files(spark: SparkSession, schema: T.StructType, paths: list[str]) -> dict[str, dict]:
    """Name of a file or folder -> {"row_count", "columns": {name: statistics}} of new fragments; one row each reaches the driver."""
    read = spark.read.schema(schema).parquet(*paths)
    # A regular expression over the path of every row cost more than all else.
    read = read.select("*", F.substring_index("_metadata.file_path", "/", -2).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    out = {}
    for r in fragment_stats(run_stats(read, schema.names)).collect():
        r = r.asDict()
        columns = {}
        for f in schema:
            low, high = r.get(f"min_{f.name}"), r.get(f"max_{f.name}")
            columns[f.name] = {
                "min": to_json(low),
                "max": to_json(high),
                "null_count": r[f"nulls_{f.name}"],
                "distinct_count": None,
                "is_sorted": r.get(f"sorted_{f.name}", False),
                "is_constant": low is not None and low == high,
            }
        out[r["_file"]] = {"row_count": r["row_count"], "columns": columns}
    return out
