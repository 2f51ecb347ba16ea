"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import engine, lifecycle, surface, tpch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _name, _text in tpch.QUERIES.items():
    QUERIES[_name] = partial(tpch.run, name=_name)
    ORACLE[_name] = _text
QUERIES |= surface.Q | engine.Q | lifecycle.Q
ORACLE |= surface.SQL | engine.SQL | lifecycle.SQL
