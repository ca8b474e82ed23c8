"""Submission (A11, J7, S14): one row per document with its labels ordered
by score (descending, ties by label id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(predictions: DataFrame, dataset: DataFrame) -> DataFrame:
    """J7 + A11 + T2: ``text_type, language, doc_id, dcterms:subject``.

    The per-document list is the output row itself; it is sorted inside the
    aggregate (no global sort)."""
    j = predictions.join(dataset.select("doc_id", "language", "text_type"), "doc_id", "inner")
    pairs = F.struct(F.negative(F.col("score")).alias("k"), F.col("label_id").alias("l"))
    return j.groupBy("doc_id").agg(
        F.first("language").alias("language"), F.first("text_type").alias("text_type"),
        F.transform(F.sort_array(F.collect_list(pairs)), lambda x: x["l"]).alias("dcterms:subject")) \
        .select("text_type", "language", "doc_id", "dcterms:subject")


def write_submission(sub: DataFrame, path: str) -> None:
    """JSON lines partitioned by text type and language, one row per
    document (not one file per document: that does not scale)."""
    sub.write.mode("overwrite").partitionBy("text_type", "language").json(path)
