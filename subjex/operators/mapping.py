"""Map stage operators (A2-A4, P3-P5, J3-J5, A15): free keywords to vocabulary
labels, threshold, id translation, allow-list, best match per (doc, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.functions.text import gnd_id


def count_rows(completions: DataFrame) -> DataFrame:
    """A2: one row per distinct completion row with its multiplicity ``size``.

    Keywords spelled like ``NA`` or ``null`` are real keywords here (trap N1);
    only true NULL candidates are dropped.
    """
    cols = completions.columns
    return completions.where(F.col("candidate").isNotNull()).groupBy(*cols) \
        .agg(F.count(F.lit(1)).alias("size"))


def distinct_candidates(completions: DataFrame) -> DataFrame:
    """A3: the search runs once per distinct keyword, not once per row."""
    return completions.select("candidate").where(F.col("candidate").isNotNull()).distinct()


def attach_matches(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Every completion row gets its keyword's match (label_id, term,
    cosine_similarity, hybrid_score). ``matches`` holds one row per distinct
    candidate, so this is a plain equi-join that AQE may broadcast when small."""
    return rows.join(matches, "candidate", "inner")


def split_threshold(df: DataFrame, min_cosine: float = 0.7,
                    col: str = "cosine_similarity") -> tuple[DataFrame, DataFrame]:
    """``cosine >= min`` is kept, ``cosine < min`` goes to the side output;
    NaN goes to neither (Spark orders NaN above every number, so it is guarded)."""
    c = F.col(col)
    valid = c.isNotNull() & ~F.isnan(c)
    return df.where(valid & (c >= min_cosine)), df.where(valid & (c < min_cosine))


def translate_ids(df: DataFrame, id_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J4 + P4: internal id -> external id with ``gnd:`` prefix.

    Rows without a mapping are dropped (not turned into ``gnd:nan``, trap N10)
    and returned as the second frame so they can be counted. The id table is
    vocabulary sized; the join is left to the planner (AQE broadcasts it only
    when its measured size is under the threshold).
    """
    missing = [c for c in ("idn", "gnd_id") if c not in id_table.columns]
    if missing:
        raise ValueError("id table needs the columns idn and gnd_id")
    t = id_table.select(F.col("idn").cast("string").alias("_idn"), F.col("gnd_id").alias("_gnd"))
    joined = df.join(t, df["label_id"].cast("string") == t["_idn"], "left")
    mapped = joined.where(F.col("_gnd").isNotNull()).select(
        *[c for c in df.columns if c != "label_id"],
        F.col("label_id").alias("internal_id"), gnd_id(F.col("_gnd")).alias("label_id"))
    unmapped = joined.where(F.col("_gnd").isNull()).select(*df.columns)
    return mapped, unmapped


def prefix_ids(df: DataFrame) -> DataFrame:
    """P4 when the search already returns external ids."""
    return df.withColumn("label_id", gnd_id(F.col("label_id")))


def allow(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep labels listed in ``allowed.nid`` (semi join on the distinct
    ids: the same final rows as an inner merge followed by the group-by)."""
    return df.join(allowed.select(F.col("nid").alias("label_id")).distinct(), "label_id", "left_semi")


def best_match(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4 / A5: one row per (key, doc, label).

    candidate and term come from the row with the greatest cosine, ties going
    to the greatest candidate (what a stable sort then ``last`` yields);
    cosine and hybrid score are plain maxima. One aggregate with a partial
    (map-side) step and no window; because ``max_by`` carries a string value
    Spark plans it as a sort aggregate, which spills rather than failing.
    """
    order = F.struct(F.col("cosine_similarity"), F.col("candidate"))
    return df.groupBy(*by, "doc_id", "label_id").agg(
        F.max_by("candidate", order).alias("candidate"),
        F.max_by("term", order).alias("term"),
        F.max("cosine_similarity").alias("cosine_similarity"),
        F.max("hybrid_score").alias("hybrid_score"))


def select_score(df: DataFrame, score_param: str = "hybrid_score") -> DataFrame:
    """P5: the score column is a copy of the chosen measure."""
    if score_param not in ("cosine_similarity", "hybrid_score"):
        raise ValueError("score_param must be cosine_similarity or hybrid_score")
    return df.withColumn("score", F.col(score_param))


def map_stats(best: DataFrame, removed: DataFrame, n_before_allow: DataFrame | None = None,
              n_after_allow: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n_keywords (rows after A4), n_matches_below_threshold and
    n_not_in_allowed_subjects (NULL when no allow-list was used)."""
    k = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keywords"))
    r = removed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_matches_below_threshold"))
    out = k.join(r, list(by), "full") if by else \
        k.select("n_keywords", r.select("n_matches_below_threshold").scalar().alias("n_matches_below_threshold"))
    if n_before_allow is not None and n_after_allow is not None:
        b = n_before_allow.groupBy(*by).agg(F.count(F.lit(1)).alias("_b"))
        a = n_after_allow.groupBy(*by).agg(F.count(F.lit(1)).alias("_a"))
        if by:
            out = out.join(b, list(by), "left").join(a, list(by), "left") \
                .withColumn("n_not_in_allowed_subjects", F.col("_b") - F.coalesce(F.col("_a"), F.lit(0))) \
                .drop("_b", "_a")
        else:
            out = out.select("*", (b.select("_b").scalar() - a.select("_a").scalar())
                             .alias("n_not_in_allowed_subjects"))
    else:
        out = out.withColumn("n_not_in_allowed_subjects", F.lit(None).cast("long"))
    return out.na.fill(0, ["n_keywords", "n_matches_below_threshold"])


def match_stats(best: DataFrame, by: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    """M10 (optional, meaning not fixed by the reference): keywords whose
    match is exact (cosine within ``eps`` of 1) and keywords matched without
    a keyword score (vector-only search)."""
    return best.groupBy(*by).agg(
        F.count_if(F.col("cosine_similarity") >= 1 - eps).alias("n_perfect_matches"),
        F.count_if(F.col("hybrid_score").isNull()).alias("n_only_vector_matches"))
