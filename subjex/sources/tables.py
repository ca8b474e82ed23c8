"""Stage tables (S5, S6, S8, S9, S10, S11): CSV / JSON / Parquet with
explicit schemas, id lists, and columns derived from file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex import schemas
from subjex.sources.split_lines import csv_records


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV read with an explicit schema (no inference pass);
    quoted multi-line fields allowed, and still many tasks read one file. The strings ``NA``/``null`` stay text
    (trap N1): only empty fields are NULL."""
    return csv_records(spark, path, schema).drop("file", "start", "line")


def stringified_list(c: Column) -> Column:
    """``"['a', 'b']"`` (a Python list literal written by a CSV) -> array.
    Items are single- or double-quoted strings."""
    items = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), 0)
    return F.transform(items, lambda s: F.regexp_replace(F.substring(s, 2, 1 << 30), r".$", ""))


def read_dataset_csv(spark: SparkSession, path: str) -> DataFrame:
    """D2 from its CSV form, list columns parsed back into arrays."""
    df = read_csv(spark, path, schemas.DATASET_CSV)
    return df.withColumn("dcterms:subject", stringified_list(F.col("`dcterms:subject`"))) \
        .withColumn("labels", stringified_list(F.col("labels")))


def read_id_list(spark: SparkSession, path: str | None, col: str = "idn") -> DataFrame | None:
    """Allow / deny id list; no path means no filter (None)."""
    if not path:
        return None
    return read_csv(spark, path, f"{col} string").select(F.col(col).alias("doc_id")).distinct()


def member_from_path(path_col: str = "file_path"):
    """``<model>_<prompt>`` from ``.../<model>/<prompt>/<file>``."""
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    return F.concat_ws("_", F.element_at(parts, n - 2), F.element_at(parts, n - 1))


def read_member_tables(spark: SparkSession, root: str, file_name: str = "predictions.csv",
                       schema=None, excluded: tuple[str, ...] = ("predictions.csv", "ranked_predictions.csv")) -> DataFrame:
    """S10 + S11: every ``<root>/<model>/<prompt>/<file_name>`` found under the
    root (``file_name`` may hold wildcards), with model and prompt taken from the path (one union by listing).
    ``excluded`` files directly below the root belong to no run."""
    rows = csv_records(spark, root, schema or schemas.PREDICTIONS_CSV, glob=file_name, recursive=True)
    # the path as written, without a scheme, ends the same way in any file system
    base = re.sub(r"^[a-z0-9+.-]+:/*", "/", root).rstrip("/")
    for name in excluded:
        rows = rows.where(~F.endswith("file", F.lit(f"{base}/{name}")))
    parts = F.split("file", "/")
    n = F.size(parts)
    own = [c for c in rows.columns if c not in ("file", "start", "line")]
    return rows.select(*own, F.element_at(parts, n - 2).alias("model"), F.element_at(parts, n - 1).alias("prompt"))


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Stage tables written by this library: Parquet partitioned by
    ``model=/prompt=``; filters on those columns prune directories."""
    return spark.read.parquet(path)
