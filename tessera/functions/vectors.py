"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(v) -> Column:
    return F.array(*(F.lit(float(x)) for x in v)) if isinstance(v, (list, tuple)) else v


def dot(a, b) -> Column:
    """Sum of products; null where the sizes differ."""
    a, b = _column(a), _column(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where the sizes differ."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_normalise(a) -> Column:
    n = norm(a)
    return F.when(n == 0, _column(a)).otherwise(F.transform(_column(a), lambda x: x.cast("double") / n))
