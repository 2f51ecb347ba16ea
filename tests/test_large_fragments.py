"""Fragments of more rows than one task should write or look at."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import Catalog, WriteConfig
from tessera.sources import pruning as P
from tessera.sources import table


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(table, "FILE_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def made(spark, path, rows):
    c = Catalog(spark, str(path))
    c.create_table("t", rows.schema)
    c.writer("t", WriteConfig(max_buffer_rows=10**9)).write(rows).commit()
    return c


def test_one_fragment_by_many_tasks(spark, tmp_path, small):
    """A large fragment used to be written by one task; as a folder it is read, pruned, compacted and deleted as one."""
    rows = spark.range(1000, numPartitions=5).select(F.col("id").alias("k"), F.lit("x").alias("c"))
    c = made(spark, tmp_path / "db", rows)
    (f,) = c.fragments("t")
    names = c.files.names(f.path)
    assert len([n for n in names if n.endswith(".parquet")]) > 1 and f.row_count == 1000 and f.size_bytes == c.files.size(f.path) > 0
    assert f.columns["k"]["is_sorted"] and (f.columns["k"]["min"], f.columns["k"]["max"]) == (0, 999) and f.columns["c"]["is_constant"] and f.columns["c"]["is_sorted"]
    assert c.scan("t", [P.compare("k", "=", 41)]).count() == 1 and c.reader("t").read_fragment(f.id).count() == 1000
    c.writer("t").write(rows.limit(10)).commit()
    assert len(c.compact("t")) == 1 and c.vacuum() == 2 and c.reader("t").read_combined().count() == 1010


@pytest.mark.parametrize("swap", [None, (15, 16), (3, 4), (399, 400), (200, 990)])
def test_order_within_and_across_batches_and_files(spark, tmp_path, small, swap):
    values = [float(i) if i % 3 else None for i in range(1000)]
    if swap:
        a, b = swap
        values[a], values[b] = b + 0.5, a - 0.5
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(v,) for v in values], 5), "v double")
    (f,) = made(spark, tmp_path / "db", rows).fragments("t")
    assert f.columns["v"]["is_sorted"] is (swap is None) and f.row_count == 1000


def test_statistics_follow_the_order_of_spark(spark, tmp_path):
    nan = float("nan")
    rows = spark.createDataFrame([(nan, True, "a", -0.0), (1.0, False, "é", 0.0), (nan, None, "z", nan)], "a double, b boolean, s string, z double").coalesce(1)
    f = made(spark, tmp_path / "db", rows).fragments("t")[0].columns
    assert (f["a"]["min"], f["a"]["max"], f["a"]["is_sorted"]) == (1.0, "nan", False) and f["z"]["is_sorted"]
    assert (f["b"]["min"], f["b"]["max"], f["b"]["is_sorted"], f["b"]["null_count"]) == (False, True, False, 1)
    assert (f["s"]["min"], f["s"]["max"], f["s"]["is_sorted"]) == ("a", "é", False)
