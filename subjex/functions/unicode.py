"""Unicode normalisation (trap N8): Spark 4.1 has no NFC function, so this is
an Arrow-batched pandas UDF; it runs once per distinct label text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@F.pandas_udf("string")
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    return _nfc(c)
