"""Dense-vector column functions (F13). Spark 4.1 has no vector SQL functions,
so these are higher-order array expressions computed in double precision.
They suit checks and small probes; the bulk nearest-label search is the
blocked matrix product in ``operators.knn``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def normalize(a: Column) -> Column:
    """Unit-norm copy of a vector (float32 elements, as stored)."""
    n = l2_norm(a)
    return F.transform(a, lambda v: (v.cast("double") / n).cast("float"))
