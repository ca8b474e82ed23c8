"""Run-time checks E11 / A18 (S2 lives in sources.records; V3 in ranking,
P14 in combine).

Each check is one aggregate job that fails with a clear message; none pulls
rows to the driver beyond a count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """V1: no key tuple twice."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"There are non-unique tuples {tuple(keys)} in the {what}.")
    return df


def assert_not_null(df: DataFrame, col: str, what: str = "rows") -> DataFrame:
    """V2: no missing value in ``col``."""
    n = df.where(F.col(col).isNull()).limit(1).count()
    if n:
        raise ValueError(f"missing {col} in the {what}")
    return df


def assert_not_empty(df: DataFrame, what: str) -> DataFrame:
    """V4: a side that must hold rows."""
    if df.limit(1).count() == 0:
        raise ValueError(f"No documents in {what}.")
    return df


def check_gold(gold: DataFrame) -> DataFrame:
    """V1 + V2 on the gold standard."""
    assert_unique(gold, ["doc_id", "label_id"], "ground truth")
    return assert_not_null(gold, "label_id", "ground truth")
