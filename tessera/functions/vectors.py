"""Vector distances as column expressions, computed in double precision.

Vectors of different length raise; a null vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _column(v: Column | str | Sequence[float]) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``f`` over paired components."""
    paired = _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double")).otherwise(paired)


def euclidean(a, b) -> Column:
    """Root of the summed squared differences."""
    return F.sqrt(_zip(_column(a), _column(b), lambda x, y: (x - y) * (x - y)))


def manhattan(a, b) -> Column:
    """Summed absolute differences."""
    return _zip(_column(a), _column(b), lambda x, y: F.abs(x - y))


def dot(a, b) -> Column:
    """Inner product."""
    return _zip(_column(a), _column(b), lambda x, y: x * y)


def dot_distance(a, b) -> Column:
    """Negated inner product, so that smaller is nearer."""
    return -dot(a, b)


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_column(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a, b) -> Column:
    """Inner product over norms; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine(a, b) -> Column:
    """1 - similarity; 1 if a norm is 0."""
    return 1.0 - cosine_similarity(a, b)


METRICS: dict[str, Callable[..., Column]] = {"euclidean": euclidean, "cosine": cosine, "dot": dot_distance, "manhattan": manhattan}


def distance(metric: str, a, b) -> Column:
    """One of the four metrics by name."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric](a, b)


_PAIRS = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, v) -> s + v)"
_NORM = "sqrt(aggregate(transform({0}, x -> x * x), 0D, (s, v) -> s + v))"
_DOT = _PAIRS.format("x * y")
SQL = {
    "euclidean_distance": f"sqrt({_PAIRS.format('(x - y) * (x - y)')})",
    "manhattan_distance": _PAIRS.format("abs(x - y)"),
    "dot_product": _DOT,
    "cosine_similarity": f"CASE WHEN {_NORM.format('a')} * {_NORM.format('b')} = 0 THEN 0D ELSE {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) END",
}


def register(spark: SparkSession) -> None:
    """The functions as temporary SQL functions; Catalyst sees through them."""
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
