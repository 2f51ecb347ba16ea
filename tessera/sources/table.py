"""Writing and reading tables."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .catalog import Catalog, Fragment
from .config import WriteConfig
from .stats import of_files


#: Rows that one task writes as one file; a larger fragment is a folder of files in the order of their names.
FILE_ROWS = 1 << 20


def write_fragments(catalog: Catalog, df: DataFrame, schema: T.StructType, config: WriteConfig, whole: bool = False) -> list[Fragment]:
    """Every output file of ``df`` becomes a fragment, or with ``whole`` all of them one: executors write them, the driver moves names and gets one row of statistics each."""
    files, temporary = catalog.files, f"data/_tmp-{uuid.uuid4().hex}"
    df.write.options(**config.options()).parquet(f"{catalog.path}/{temporary}")
    places = {}
    written = [name for name in files.names(temporary) if name.endswith(".parquet")]
    if whole and len(written) > 1:
        fragment = uuid.uuid4().hex
        files.move(temporary, f"data/{fragment}.parquet")
        places[f"{fragment}.parquet"] = fragment
    else:
        for name in written:
            fragment = uuid.uuid4().hex
            files.move(f"{temporary}/{name}", f"data/{fragment}.parquet")
            places[f"{fragment}.parquet"] = fragment
        files.delete(temporary)
    if not places:
        return []
    found = of_files(catalog.spark, schema, [f"{catalog.path}/data/{n}" for n in places])
    out = []
    for name, fragment in places.items():
        if name not in found:  # an empty file of an empty partition
            files.delete(f"data/{name}")
            continue
        out.append(Fragment(fragment, f"data/{name}", found[name]["row_count"], files.size(f"data/{name}"), found[name]["columns"]))
    return out


class Writer:
    """Buffers DataFrames and writes them as fragments on ``flush``, ``commit`` or when the buffer is full."""

    def __init__(self, catalog: Catalog, table: str, config: WriteConfig):
        self.catalog, self.table, self.config = catalog, table, config
        self.schema = catalog.schema(table)
        self.pending: list[DataFrame] = []
        self.buffered_rows = 0

    def write(self, df: DataFrame, check: bool = True) -> "Writer":
        """Add rows whose schema equals the table's."""
        S.require_equal(self.schema, df.schema)
        rows, broken = df.agg(F.count("*"), F.count(F.when(S.violations(self.schema), 1)) if check else F.lit(0)).first()
        if broken:
            raise ValueError("rows break a NOT NULL or a vector dimension")
        self.pending.append(df)
        self.buffered_rows += rows
        if self.buffered_rows >= self.config.max_buffer_rows:
            self.flush()
        return self

    def flush(self) -> list[Fragment]:
        """Write what is buffered; nothing for an empty buffer.  One fragment for up to ``max_buffer_rows`` rows."""
        if not self.buffered_rows:
            self.pending = []
            return []
        df = self.pending[0]
        for more in self.pending[1:]:
            df = df.unionByName(more)
        pieces = -(-self.buffered_rows // self.config.max_buffer_rows)
        large = pieces == 1 and self.buffered_rows > FILE_ROWS  # as many tasks write it as there are partitions, and their order stays
        df = df.repartition(pieces) if pieces > 1 else df if large else df.coalesce(1)
        new = write_fragments(self.catalog, df, self.schema, self.config, whole=large)
        self.catalog.add_fragments(self.table, new)
        self.pending, self.buffered_rows = [], 0
        return new

    commit = flush

    def __enter__(self) -> "Writer":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def __del__(self) -> None:
        if self.__dict__.get("buffered_rows"):
            warnings.warn(f"a writer of {self.table} goes with {self.buffered_rows} rows that were not committed", stacklevel=1)


class Reader:
    """Reads a table whole or by column."""

    def __init__(self, catalog: Catalog, table: str):
        self.catalog, self.table = catalog, table
        self.schema = catalog.schema(table)

    def read_all(self) -> DataFrame:
        return self.catalog.scan(self.table)

    def read_combined(self) -> DataFrame:
        """Like ``read_all``, but a table without fragments is an error."""
        if not self.catalog.fragments(self.table):
            raise ValueError(f"no data in {self.table}")
        return self.read_all()

    def read_columns(self, *names: str) -> DataFrame:
        unknown = [n for n in names if n not in self.schema.names]
        if unknown:
            raise KeyError(f"unknown columns: {', '.join(unknown)}")
        return self.catalog.scan(self.table, columns=list(names))

    def read_fragment(self, fragment_id: str) -> DataFrame:
        found = next((f for f in self.catalog.fragments(self.table) if f.id == fragment_id), None)
        if found is None:
            raise KeyError(f"unknown fragment: {fragment_id}")
        return self.catalog.spark.read.schema(self.schema).parquet(self.catalog.place(found))

    def row_count(self) -> int:
        return self.catalog.row_count(self.table)

    def size_bytes(self) -> int:
        return self.catalog.size_bytes(self.table)
