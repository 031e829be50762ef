"""Vector expressions over ``array`` columns (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: ColumnOrName) -> Column:
    """Any numeric array as ``array<double>``."""
    return _col(v).cast("array<double>")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Inner product; an error where the lengths differ (never a silent tail)."""
    a, b = _col(a), _col(b)
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: ColumnOrName, k: Column) -> Column:
    return F.transform(_col(a), lambda x: x * k)


def unit(a: ColumnOrName) -> Column:
    """L2-normalised; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, _col(a)).otherwise(F.transform(_col(a), lambda x: x / n))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity, 0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
