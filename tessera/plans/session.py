"""SQL sessions over a catalog."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import register as register_vectors
from ..sources.catalog import Catalog
from ..sources.pruning import Predicate, PruningStats, can_prune
from .pushdown import filters

_CREATE = re.compile(r"\s*create\s+table\s+(if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_INSERT = re.compile(r"\s*insert\s+into\s+(?:table\s+)?(\w+)\s+((?:select|values|with|from|table)\b.*?);?\s*$", re.I | re.S)
_DROP = re.compile(r"\s*drop\s+table\s+(if\s+exists\s+)?(\w+)\s*;?\s*$", re.I)


@dataclass
class QueryResult:
    """The rows (lazily) and the milliseconds that planning took."""

    frame: DataFrame
    elapsed_ms: float
    affected_rows: int | None = None
    pruning: dict[str, PruningStats] = field(default_factory=dict)

    def collect(self) -> list:
        began = time.perf_counter()
        rows = self.frame.collect()
        self.elapsed_ms += (time.perf_counter() - began) * 1000
        return rows


class Session:
    """Tables of a catalog as views of a Spark session; vector functions are registered for SQL."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.catalog = spark, Catalog(spark, path)
        self.registered: dict[str, tuple] = {}
        register_vectors(spark)

    def register_table(self, name: str, predicates: list[Predicate] | tuple = ()) -> None:
        """Bind a table to its name; with predicates only the rows that match.  Its fragments are listed anew for every query."""
        self.catalog.scan(name, predicates).createOrReplaceTempView(name)
        self.registered[name] = tuple(predicates)

    def register_all(self) -> None:
        for name in self.catalog.list_tables():
            self.register_table(name)

    def unregister_table(self, name: str) -> bool:
        self.registered.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def list_tables(self) -> list[str]:
        return sorted(self.registered)

    def schema(self, name: str) -> T.StructType:
        if name not in self.registered:
            raise KeyError(f"not registered: {name}")
        return self.catalog.schema(name)

    def execute(self, query: str) -> QueryResult:
        """A query, CREATE TABLE / DROP TABLE on the catalog, or INSERT INTO a table of it."""
        if _CREATE.match(query) or _DROP.match(query):
            began = time.perf_counter()
            return QueryResult(self.execute_ddl(query), (time.perf_counter() - began) * 1000)
        return self.execute_dml(query) if _INSERT.match(query) else self.execute_select(query)

    def execute_select(self, query: str) -> QueryResult:
        """Only fragments that the query's own filters can't rule out are opened.

        The query is planned over all fragments first; the filters that the
        optimizer pushed down to the scans then choose the fragments to bind.
        """
        began = time.perf_counter()
        named = [n for n in self.registered if re.search(rf"\b{re.escape(n)}\b", query)]
        for name in named:
            self.register_table(name, self.registered[name])
        frame, stats = self.spark.sql(query), {}
        places = filters(frame)
        for name in named:
            wanted = places.get(name)
            if not wanted or None in wanted:
                continue
            schema, every = self.catalog.schema(name), self.catalog.fragments(name)
            own = list(self.registered[name])
            kept = [f for f in every if not any(can_prune(p, f.row_count, f.columns, schema) for p in own) and not all(can_prune(p, f.row_count, f.columns, schema) for p in wanted)]
            stats[name] = PruningStats(len(every), len(kept), sum(f.row_count for f in every), sum(f.row_count for f in kept))
            if len(kept) < len(every):
                rows = self.catalog.open(name, kept)
                for p in own:
                    rows = rows.where(p.expression())
                rows.createOrReplaceTempView(name)
        if any(x.pruned_fragments for x in stats.values()):
            frame = self.spark.sql(query)
        return QueryResult(frame, (time.perf_counter() - began) * 1000, pruning=stats)

    def execute_dml(self, query: str) -> QueryResult:
        """INSERT INTO a catalog table: its rows, cast to the table's types by place, become fragments."""
        m = _INSERT.match(query)
        if not m:
            raise ValueError("only INSERT INTO ... SELECT or VALUES changes data here")
        began = time.perf_counter()
        schema, rows = self.catalog.schema(m[1]), self.execute_select(m[2]).frame
        if len(rows.columns) != len(schema):
            raise ValueError(f"{m[1]} has {len(schema)} columns, the query {len(rows.columns)}")
        cast = rows.toDF(*schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        before = self.catalog.row_count(m[1])
        with self.catalog.writer(m[1]) as writer:
            writer.write(cast)
        made = self.catalog.row_count(m[1]) - before
        return QueryResult(self.spark.createDataFrame([(made,)], "affected_rows long"), (time.perf_counter() - began) * 1000, made)

    def execute_ddl(self, text: str) -> DataFrame:
        if m := _CREATE.match(text):
            if not (m[1] and self.catalog.table_exists(m[2])):
                fields = self._columns(m[3])
                self.catalog.create_table(m[2], fields)
            self.register_table(m[2])
        elif m := _DROP.match(text):
            if not self.catalog.drop_table(m[2]) and not m[1]:
                raise KeyError(f"unknown table: {m[2]}")
            self.unregister_table(m[2])
        else:
            raise ValueError("only CREATE TABLE and DROP TABLE are data definitions here")
        return self.spark.createDataFrame([], T.StructType([]))

    def _columns(self, text: str) -> T.StructType:
        required, parts = set(), []
        for part in re.split(r",(?![^<(]*[>)])", text):
            name = part.split()[0]
            if re.search(r"\bnot\s+null\b", part, re.I):
                required.add(name)
            parts.append(re.sub(r"\bnot\s+null\b|\bnull\b", "", part, flags=re.I).strip())
        found = T.StructType.fromDDL(", ".join(parts)) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(", ".join(parts))
        return T.StructType([T.StructField(f.name, f.dataType, f.name not in required) for f in found])


def execute_query(spark: SparkSession, path: str, query: str) -> QueryResult:
    """One query over a catalog with all its tables registered."""
    session = Session(spark, path)
    session.register_all()
    return session.execute(query)
