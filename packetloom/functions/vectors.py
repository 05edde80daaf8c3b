"""Vector expressions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column | str, floor: float = 1e-8) -> Column:
    """Unit length; vectors shorter than ``floor`` are divided by it, so zero stays zero."""
    length = F.greatest(l2_norm(a), F.lit(floor))
    # as an argument of the fold the length is computed once per row, inside the lambda once per element
    return F.zip_with(_col(a), F.array_repeat(length, F.size(_col(a))), lambda x, n: x.cast("double") / n)


def weighted_sum(columns: list[Column], weights: list[float]) -> Column:
    """Plain sum of products: stays in generated code, unlike an array fold."""
    out = columns[0] * F.lit(float(weights[0]))
    for c, w in zip(columns[1:], weights[1:]):
        out = out + c * F.lit(float(w))
    return out
