"""Comparison of a query with its DuckDB SQL by value, order aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def assert_same(df, connection, sql):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in found.fetchall())
    got = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    assert got == expected
