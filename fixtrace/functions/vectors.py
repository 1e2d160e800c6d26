"""Column functions over vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixtrace.functions.text import as_col


def _doubles(vector: Column | str) -> Column:
    return as_col(vector).cast("array<double>")


def dot(u: Column | str, v: Column | str) -> Column:
    products = F.zip_with(_doubles(u), _doubles(v), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(u: Column | str, v: Column | str) -> Column:
    """Cosine of two vectors, 0 if one of them is all zeros."""
    norms = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.coalesce(F.try_divide(dot(u, v), norms), F.lit(0.0))
