import datetime, json, time
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.session import Session
from tessera.sources import Catalog
from tessera.streaming import events

from .conftest import DATA


def numbers(spark, path, parts=4):
    session = Session(spark, str(path))
    session.execute("CREATE TABLE t (id BIGINT NOT NULL, day DATE, name STRING)")
    for k in range(parts):
        rows = spark.range(100 * k, 100 * k + 100).select("id", F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("day"), F.concat(F.lit(f"n{k}-"), "id").alias("name"))
        rows = spark.createDataFrame(rows.rdd, session.catalog.schema("t"))
        session.catalog.writer("t").write(rows).commit()
    return session


def test_where_prunes_fragments(spark, tmp_path):
    """Filters of the query itself choose the files, for each kind of condition, self-joins and subqueries too."""
    session = numbers(spark, tmp_path)
    cases = {
        "id >= 350": 1, "id < 100 AND name LIKE 'n%'": 1, "250 > id AND id > 120": 2, "id = 5 OR id = 395": 2, "id IN (1, 2, 301)": 2, "id BETWEEN 110 AND 120": 1, "day = DATE '2020-01-02'": 1,
        "name >= 'n3'": 1, "id + 0 = 5": 1, "id % 7 = 5": 4, "id > 1000": 0, "id IS NULL": 0, "id <> 5": 4, "NOT (id < 300)": 1,
    }
    for where, files in cases.items():
        made = session.execute(f"SELECT id FROM t WHERE {where}")
        assert len(made.frame.inputFiles()) == files, where
        everything = session.catalog.scan("t").where(where.replace("id IS NULL", "id IS NULL"))
        assert sorted(r.id for r in made.collect()) == sorted(r.id for r in everything.select("id").collect())
    both = session.execute("SELECT a.id FROM t a JOIN t b ON a.id + 300 = b.id WHERE a.id < 50 AND b.id >= 300")
    assert both.pruning["t"].remaining_fragments == 2 and len(both.collect()) == 50
    assert len(session.execute("SELECT id FROM t WHERE id < 10 OR id IN (SELECT id FROM t WHERE id > 395)").collect()) == 14
    assert session.execute("WITH x AS (SELECT * FROM t WHERE id >= 300) SELECT COUNT(*) AS n FROM x").collect()[0].n == 100


def test_new_fragments_are_seen(spark, tmp_path):
    session = numbers(spark, tmp_path, 1)
    assert session.execute("SELECT COUNT(*) AS n FROM t").collect()[0].n == 100
    made = session.execute("INSERT INTO t SELECT id + 1000, day, name FROM t WHERE id < 7")
    assert made.affected_rows == 7 and session.execute("SELECT COUNT(*) AS n FROM t WHERE id >= 1000").collect()[0].n == 7
    with pytest.raises(ValueError):
        session.execute("INSERT INTO t SELECT id FROM t")


def test_two_streams_lose_nothing(spark, tmp_path):
    """Two streams into one table, and one of them again with a new checkpoint: every row stays."""
    source = tmp_path / "in"
    spark.range(10).write.parquet(str(source / "a"))
    spark.range(20).write.parquet(str(source / "b"))
    catalog = Catalog(spark, str(tmp_path / "db"))
    catalog.create_table("t", T.StructType([T.StructField("id", T.LongType())]))
    for name, checkpoint in (("a", "one"), ("b", "two"), ("b", "three"), ("b", "two")):
        stream = spark.readStream.schema("id long").parquet(str(source / name))
        events.append_to(stream, catalog, "t", str(tmp_path / checkpoint)).awaitTermination()
    assert catalog.row_count("t") == 50 and catalog.scan("t").count() == 50


def test_locks(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.files.write("manifest.json.lock", json.dumps({"owner": "gone", "time": 0}))
    with pytest.raises(RuntimeError):
        catalog._edit(lambda c: None, wait=0.2, stale=60)
    began = time.time()
    while catalog.files.age("manifest.json.lock") < 0.5:
        time.sleep(0.1)
    catalog._edit(lambda c: c.update(mark=1), wait=5, stale=0.3)
    assert catalog.manifest()["mark"] == 1 and not catalog.files.exists("manifest.json.lock") and time.time() - began < 30
