"""Distances and similarity scores of vectors, as columns in double precision.

Euclidean is the squared distance, dot product 1 - x.y, cosine 1 - cos (1 if
either norm is 0, kept within 0 and 2), hamming the number of signs that
differ (a sign is x > 0; NaN, 0 and negatives are equal).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("EUCLIDEAN", "COSINE", "DOT_PRODUCT", "HAMMING")


def kind_of(name: str | None) -> str:
    """A metric by name in any case; COSINE if the name is unknown."""
    return name.upper() if name and name.upper() in KINDS else "COSINE"


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _total(x: Column, y: Column, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return _total(x, y, lambda a, b: a.cast("double") * b.cast("double"))


def distance(kind: str, x: Column, y: Column) -> Column:
    """Distance of two array columns of one length; null if either is null or it is NaN."""
    if kind == "EUCLIDEAN":
        d = _total(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    elif kind == "COSINE":
        norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        d = F.when(norms == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(x, y) / norms)))
    elif kind == "DOT_PRODUCT":
        d = 1 - dot(x, y)
    elif kind == "HAMMING":
        sign = lambda a: (a > 0) & ~F.isnan(a.cast("double"))
        d = _total(x, y, lambda a, b: F.when(sign(a) != sign(b), 1.0).otherwise(0.0))
    else:
        raise ValueError(f"unknown metric {kind}")
    return F.when(~F.isnan(d), d)


def similarity(kind: str, d: Column, dimension: int) -> Column:
    """Score of a distance: (2 - d) / 2, 1 / (1 + d) or 1 - d / dimension."""
    if kind == "EUCLIDEAN":
        return 1 / (1 + d)
    return 1 - d / F.lit(float(dimension)) if kind == "HAMMING" else (2 - d) / 2


def saturated(x: Column) -> Column:
    """Infinities as the largest single-precision number."""
    top = F.lit(3.4028234663852886e38)
    return F.when(x == float("inf"), top).when(x == float("-inf"), -top).otherwise(x)
