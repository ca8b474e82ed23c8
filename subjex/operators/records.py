"""Dataset shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.sources.records import SUBJECT_SETS


def dedupe_docs(df: DataFrame, subject_order: Sequence[str] = SUBJECT_SETS) -> DataFrame:
    """A1: one row per doc_id. The first in the reference's reading order
    wins: subject set (argument order), split, text type, language (sorted),
    then file path (deterministic instead of directory order). Rows without
    a doc_id are dropped (count them with :func:`count_missing_ids`)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in subject_order]), F.col("subjects")) \
        if "subjects" in df.columns else F.lit(0)
    order = [rank] + [F.col(c) for c in ("split", "text_type", "language", "file_path") if c in df.columns]
    w = Window.partitionBy("doc_id").orderBy(*order)
    return df.where(F.col("doc_id").isNotNull()).withColumn("_rn", F.row_number().over(w)) \
        .where("_rn = 1").drop("_rn")


def count_missing_ids(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("doc_id").isNull()).alias("n_without_doc_id"))


def exclude_docs(df: DataFrame, deny: DataFrame | None) -> DataFrame:
    """Anti join with the deny list (null-safe, unlike NOT IN)."""
    return df if deny is None else df.join(deny.select("doc_id").distinct(), "doc_id", "left_anti")


def include_docs(df: DataFrame, allow: DataFrame | None, sample_size: int | None = None) -> DataFrame:
    """Semi join with the include list. An include list together with a
    sample is refused (the reference writes nothing then)."""
    if allow is None:
        return df
    if sample_size is not None:
        raise ValueError("cannot use an include list and a sample at the same time")
    return df.join(allow.select("doc_id").distinct(), "doc_id", "left_semi")


def stratified_sample(df: DataFrame, n: int | None, seed: int = 42,
                      by: Sequence[str] = ("subjects", "language", "text_type"),
                      bucket_bits: int = 16) -> DataFrame:
    """Exact-size stratified sample, frac = n / total, per stratum
    ``round_half_even(frac * stratum size)`` rows: those with the smallest
    seeded hash (ties by doc_id). n > total (or None) returns everything. The
    sizes are those of the reference; which rows are chosen differs (another
    generator).

    A stratum can hold a large share of all rows, so no window runs over a
    stratum: rows fall into 65,536 hash buckets (the hash's top 16 bits, which
    keep its order), per-(stratum, bucket) counts are a partial aggregate, a
    running count over the buckets of a stratum (at most 65,536 rows) finds
    the bucket where the quota is reached, and only that bucket is ranked.
    """
    if n is None:
        return df
    by = [c for c in by if c in df.columns]
    total = df.select(F.count(F.lit(1))).scalar()
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    x = df.withColumn("_h", h).withColumn("_bk", F.shiftright(F.col("_h"), 64 - bucket_bits).cast("int"))
    counts = x.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    w_all = Window.partitionBy(*by)
    w_run = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.bround(F.lit(n).cast("double") / total * F.sum("_c").over(w_all), 0)
    plan = counts.select(*by, "_bk", "_c", quota.alias("_q"),
                         F.coalesce(F.sum("_c").over(w_run), F.lit(0)).alias("_before"))
    # whole buckets below the quota, and the one bucket that crosses it
    plan = plan.where(F.col("_before") < F.col("_q")).select(
        *by, "_bk", (F.col("_q") - F.col("_before")).alias("_need"), "_c")
    picked = x.join(plan, [*by, "_bk"], "inner")
    full = picked.where(F.col("_c") <= F.col("_need"))
    edge = picked.where(F.col("_c") > F.col("_need"))
    w_edge = Window.partitionBy(*by, "_bk").orderBy("_h", "doc_id")
    edge = edge.withColumn("_rn", F.row_number().over(w_edge)).where(F.col("_rn") <= F.col("_need")).drop("_rn")
    sampled = full.unionByName(edge).drop("_h", "_bk", "_need", "_c")
    everything = F.lit(n) > total
    return df.where(everything).unionByName(sampled.where(~everything))
