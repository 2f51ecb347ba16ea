import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema as S
from tessera.sources import pruning as P
from tessera.plans.session import Session, execute_query
from tessera.sources import Catalog, WriteConfig, codec

NUMBERS = S.schema(T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), True))


def rows(spark, ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], NUMBERS)


def stats(low, high, nulls=0, constant=False):
    return {"v": {"min": low, "max": high, "null_count": nulls, "distinct_count": None, "is_sorted": False, "is_constant": constant}}


def kind(t):
    return T.StructType([T.StructField("v", t)])


TRUTH = [
    (">", 60, True), (">", 50, True), (">", 40, False), (">", 5, False), (">=", 60, True), (">=", 51, True), (">=", 50, False), (">=", 10, False), ("<", 5, True), ("<", 10, True), ("<", 15, False),
    ("<", 60, False), ("<=", 5, True), ("<=", 9, True), ("<=", 10, False), ("<=", 60, False), ("=", 5, True), ("=", 60, True), ("=", 30, False), ("=", 10, False), ("=", 50, False), ("!=", 30, False),
]


@pytest.mark.parametrize("op,value,pruned", TRUTH)
def test_truth_table(op, value, pruned):
    assert P.can_prune(P.compare("v", op, value), 9, stats(10, 50), kind(T.LongType())) is pruned


def test_pruning_by_type():
    long = kind(T.LongType())
    assert P.can_prune(P.compare("v", "!=", 42), 5, stats(42, 42, constant=True), long)
    assert not P.can_prune(P.compare("v", "!=", 0), 5, stats(42, 42, constant=True), long)
    assert not P.can_prune(P.compare("w", "=", 1), 5, stats(10, 50), long)
    assert not P.can_prune(P.compare("v", ">", "text"), 5, stats(10, 50), long)  # incomparable stays
    big = 2**53
    assert not P.can_prune(P.compare("v", ">", big), 5, stats(0, big + 1), long)  # no rounding through doubles
    assert P.can_prune(P.compare("v", ">", "zzz"), 5, stats("alice", "charlie"), kind(T.StringType()))
    assert not P.can_prune(P.compare("v", "=", "bob"), 5, stats("alice", "charlie"), kind(T.StringType()))
    assert P.can_prune(P.compare("v", "<", datetime.date(1995, 1, 1)), 5, stats("1995-01-01", "1996-01-01"), kind(T.DateType()))
    assert not P.can_prune(P.compare("v", "<", 24), 5, stats("1.00", "50.00"), kind(T.DecimalType(15, 2)))
    assert P.can_prune(P.compare("v", ">", decimal.Decimal("50.00")), 5, stats("1.00", "50.00"), kind(T.DecimalType(15, 2)))
    assert not P.can_prune(P.compare("v", ">", 100.0), 5, stats(10.5, "nan"), kind(T.DoubleType()))
    assert P.can_prune(P.is_null("v"), 5, stats(1, 2), long) and P.can_prune(P.is_not_null("v"), 5, stats(None, None, 5), long)
    assert P.can_prune(P.one_of("v", [1, 2]), 5, stats(10, 50), long) and not P.can_prune(P.one_of("v", [1, 20]), 5, stats(10, 50), long)
    assert P.can_prune(P.between("v", 60, 70), 5, stats(10, 50), long)
    assert P.can_prune(P.compare("v", ">", 60) | P.compare("v", "<", 5), 5, stats(10, 50), long)
    assert not P.can_prune(~P.compare("v", "=", 20), 5, stats(10, 50), long)
    assert P.reversed_compare(60, "<", "v") == P.compare("v", ">", 60)


@pytest.mark.parametrize("low,high,meets", [(20, 30, True), (60, 80, False), (0, 5, False), (50, 60, True), (0, 10, True), (None, 30, True), (30, None, True), (60, None, False)])
def test_overlaps(low, high, meets):
    assert P.overlaps_range("v", low, high, stats(10, 50), kind(T.LongType())) is meets
    assert P.overlaps_range("unknown", low, high, stats(10, 50), kind(T.LongType()))


def test_write_read_prune_compact(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "db"))
    c.create_table("t", NUMBERS)
    with pytest.raises(ValueError):
        c.create_table("t", NUMBERS)
    w = c.writer("t")
    for start in (0, 100, 200):
        w.write(rows(spark, range(start, start + 100)))
        assert w.buffered_rows == 100
        w.commit()
    assert w.flush() == []
    fragments = c.fragments("t")
    assert [(f.columns["id"]["min"], f.columns["id"]["max"]) for f in fragments] == [(0, 99), (100, 199), (200, 299)]
    assert all(f.columns["id"]["is_sorted"] and f.size_bytes == c.files.size(f.path) for f in fragments)
    kept, found = c.prune("t", [P.compare("id", ">", 250)])
    assert len(kept) == 1 and found.pruned_fragments == 2 and found.pruned_rows == 200 and abs(found.ratio - 2 / 3) < 1e-9
    df = c.scan("t", [P.compare("id", ">", 250)], ["name"])
    assert df.count() == 49 and df.columns == ["name"] and len(df.inputFiles()) == 1
    empty = c.scan("t", [P.compare("id", ">", 1000)], ["name"], 5)
    assert empty.count() == 0 and empty.columns == ["name"]
    assert Catalog(spark, str(tmp_path / "db")).row_count("t") == 300
    assert len(c.compact("t")) == 1 and c.reader("t").read_combined().count() == 300
    assert c.vacuum() == 3 and c.reader("t").read_all().count() == 300
    assert c.remove_fragment("t", c.fragments("t")[0].id) and c.row_count("t") == 0
    with pytest.raises(ValueError):
        c.reader("t").read_combined()
    assert c.drop_table("t") and c.list_tables() == []
    with pytest.raises(KeyError):
        c.schema("t")


def test_flags_and_types(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "db"))
    s = S.schema(T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("d", T.DateType()), T.StructField("m", T.DecimalType(15, 2)), S.vector("v", 2))
    c.create_table("t", s)
    day = datetime.date(2020, 1, 1)
    data = [(1, 5, day, decimal.Decimal("1.50"), [0.1, 0.2]), (None, 2, day, None, [0.3, 0.4]), (3, 8, day, decimal.Decimal("2.50"), [0.5, 0.6])]
    c.writer("t").write(spark.createDataFrame(data, s)).commit()
    f = c.fragments("t")[0].columns
    assert f["a"]["is_sorted"] and not f["b"]["is_sorted"] and f["d"]["is_constant"] and f["a"]["null_count"] == 1
    assert f["m"]["min"] == "1.50" and f["v"]["min"] is None
    assert not c.prune("t", [P.compare("m", "<", 24)])[1].pruned_fragments
    assert S.vector_dimension(c.schema("t")["v"]) == 2
    with pytest.raises(ValueError):
        c.writer("t").write(spark.createDataFrame([(1, 1, day, None, [0.1])], s))
    with pytest.raises(ValueError):
        c.writer("t").write(rows(spark, [1]))
    with pytest.raises(ValueError):
        S.schema(T.StructField("x", T.LongType()), T.StructField("x", T.LongType()))


def test_zones(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "db"))
    c.create_table("t", NUMBERS)
    c.writer("t", WriteConfig(row_block_size=32)).write(rows(spark, range(100))).commit()
    from tessera.plans.profile import MetricsScope, compare, export_json, profile, report

    p = profile(c.scan("t", [P.compare("id", "<=", 10)]))
    assert p.row_count == 11
    scope = MetricsScope("session")
    assert scope.read(p)["numOutputRows_session_total"] == 32
    assert scope.read(p)["numOutputRows_session_total"] == 64
    assert "Scan" in report(p) and compare(p, p)["total"]["difference_ms"] == 0 and "phases_ms" in export_json(p)


def test_codecs(spark, tmp_path):
    with pytest.raises(ValueError):
        codec("brotli2")
    with pytest.raises(ValueError):
        codec("zstd", 23)
    for name in ("zstd", "lz4", "none"):
        c = Catalog(spark, str(tmp_path / name))
        c.create_table("t", NUMBERS)
        c.writer("t", WriteConfig(compression=name)).write(rows(spark, range(5))).commit()
        assert c.reader("t").read_all().count() == 5


def test_session(spark, tmp_path):
    path = str(tmp_path / "db")
    s = Session(spark, path)
    s.execute("CREATE TABLE people (id BIGINT NOT NULL, name STRING)")
    s.catalog.writer("people").write(rows(spark, range(3))).commit()
    s.register_table("people")
    assert s.execute("SELECT COUNT(*) AS n FROM people").collect()[0].n == 3
    assert s.list_tables() == ["people"] and s.schema("people").names == ["id", "name"]
    assert execute_query(spark, path, "SELECT MAX(id) AS m FROM people").collect()[0].m == 2
    assert abs(s.execute("SELECT euclidean_distance(array(1D,2D,3D), array(4D,5D,6D)) AS d").collect()[0].d - 27**0.5) < 1e-9
    assert s.execute("SELECT cosine_similarity(array(1D,0D), array(0D,0D)) AS d").collect()[0].d == 0
    s.execute("DROP TABLE people")
    assert s.list_tables() == [] and not s.catalog.table_exists("people")
    with pytest.raises(KeyError):
        s.execute("DROP TABLE people")


def test_stream(spark, tmp_path):
    from tessera.streaming import events as E

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    src.repartition(3).write.parquet(folder)
    c = Catalog(spark, str(tmp_path / "db"))
    c.create_table("events", src.schema)
    E.append_to(E.read_events(spark, folder, src.schema), c, "events", str(tmp_path / "cp")).awaitTermination()
    assert c.row_count("events") == src.count() and c.reader("events").read_all().count() == src.count()
    E.append_to(E.read_events(spark, folder, src.schema), c, "events", str(tmp_path / "cp")).awaitTermination()
    assert c.row_count("events") == src.count()
    stream = E.windowed(E.read_events(spark, folder, src.schema, 10), "1 day", late="60 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").groupBy().agg(F.sum("n")).first()[0] == src.count()
