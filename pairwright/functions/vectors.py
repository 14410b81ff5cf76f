"""Dense-vector column functions (T18-T22) on ``array<float|double>``.

Spark 4.1 registers no vector built-ins, so these are higher-order array
expressions (``zip_with`` / ``aggregate`` / ``transform``), evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    squares = F.transform(_as_double(v), lambda x: x * x)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero length."""
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)


def l2_normalize(v) -> Column:
    # bound as lambda variables, the vector and its norm are evaluated once a row, not once an element
    def unit(d: Column, n: Column) -> Column:
        return F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n))

    return F.transform(F.array(_as_double(v)), lambda d: F.transform(F.array(norm(d)), lambda n: unit(d, n))[0])[0]


def sharpened_abs(cos: Column) -> Column:
    """Evaluation score: ``|cos^3|``."""
    return F.abs(F.pow(cos, 3))


def sharpened_signed(cos: Column) -> Column:
    """Selection score: signed ``cos^3``."""
    return F.pow(cos, 3)


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def energy(avg, target) -> Column:
    """Per-reference ``|target - avg|``."""
    return F.zip_with(_col(avg), _col(target), lambda a, t: F.abs(t - a))


def max_energy(avg, target) -> Column:
    return F.array_max(energy(avg, target))


def incremental_mean(avg, n, v) -> Column:
    """``(avg * n + v) / (n + 1)`` element-wise."""
    nn = _col(n).cast("double")
    return F.zip_with(_col(avg), _as_double(v), lambda m, x: (m * nn + x) / (nn + 1))


def element_sum(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)
