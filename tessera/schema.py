"""Explicit schemas: construction, vector columns, exact validation, JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR_DIM = "vector_dim"


def schema(*fields: T.StructField) -> T.StructType:
    """A schema; field names must differ."""
    names = [f.name for f in fields]
    again = sorted({n for n in names if names.count(n) > 1})
    if again:
        raise ValueError(f"duplicate fields: {', '.join(again)}")
    return T.StructType(list(fields))


def vector(name: str, dim: int, nullable: bool = False) -> T.StructField:
    """A column of float vectors of one dimension."""
    if dim < 1:
        raise ValueError("a vector needs a dimension of 1 or more")
    return T.StructField(name, T.ArrayType(T.FloatType(), False), nullable, {VECTOR_DIM: dim})


def is_vector(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType)


def vector_dimension(field: T.StructField) -> int | None:
    """The declared dimension of a float vector column."""
    return field.metadata.get(VECTOR_DIM) if is_vector(field) and isinstance(field.dataType.elementType, T.FloatType) else None


def _shape(s: T.StructType) -> list[tuple]:
    return [(f.name, f.dataType.simpleString()) for f in s.fields]


def require_equal(expected: T.StructType, given: T.StructType) -> None:
    """Names, order and types must be equal: nothing is widened or reordered."""
    if _shape(expected) != _shape(given):
        raise ValueError(f"schema mismatch: table has {_shape(expected)}, data has {_shape(given)}")


def conform(df: DataFrame, expected: T.StructType) -> DataFrame:
    """``df`` cast to the schema by name; the explicit way around ``require_equal``."""
    missing = [f.name for f in expected if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in expected])


def violations(expected: T.StructType) -> Column:
    """A condition that is true for rows that break a NOT NULL or a vector dimension."""
    bad = F.lit(False)
    for f in expected:
        if not f.nullable:
            bad = bad | F.col(f.name).isNull()
        dim = vector_dimension(f)
        if dim is not None:
            bad = bad | (F.col(f.name).isNotNull() & (F.size(f.name) != dim))
    return bad


def orderable(kind: T.DataType) -> bool:
    """Types that get minimum and maximum statistics."""
    return isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
