"""Score arithmetic with explicit NaN handling (traps N3, N4, N5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clip01(c: Column) -> Column:
    """Clip to [0, 1]; NaN becomes NULL so that a later sum skips it,
    as pandas does (Spark's least/greatest would turn NaN into 1.0)."""
    x = nan_to_null(c.cast("double"))
    # least/greatest skip NULL arguments, so a NULL must bypass them
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def weighted(vote: Column, relevance: Column, weight: float) -> Column:
    """``weight * vote + (1 - weight) * relevance``."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must lie in [0, 1]")
    return F.lit(weight) * vote + F.lit(1.0 - weight) * relevance


def safe_ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of failing on a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def stable_round(c: Column, digits: int = 6) -> Column:
    """Round half up by the same IEEE operations any engine performs alike:
    first to 1e-9 (absorbs summation-order noise), then to ``digits``. Values
    whose billionfold does not fit a long have no such noise to lose and stay."""
    x = c.cast("double")
    pre = F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
    scale = float(10 ** digits)
    out = F.floor(pre * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(9e9)), x).otherwise(out)
