"""Combine vote and relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.functions.scores import weighted


def combine(ensemble: DataFrame, ranked: DataFrame, weight: float = 0.3,
            by: Sequence[str] = ()) -> DataFrame:
    """Full outer join on (doc, label); a side missing a pair scores 0 there;
    ``score = weight * vote + (1 - weight) * relevance``.

    The range check (P14) is part of the same plan: a score outside [0, 1]
    fails the job when it is computed (NaN fails too, trap N4).
    """
    keys = [*by, "doc_id", "label_id"]
    # The two score columns get the suffixes _ensemble / _relevance
    e = ensemble.withColumnRenamed("score", "score_ensemble")
    r = ranked.select(*keys, F.col("score").alias("score_relevance"))
    j = e.join(r, keys, "full_outer") \
        .withColumn("score_ensemble", F.coalesce("score_ensemble", F.lit(0.0))) \
        .withColumn("score_relevance", F.coalesce("score_relevance", F.lit(0.0)))
    s = weighted(F.col("score_ensemble"), F.col("score_relevance"), weight)
    checked = F.when((s < 0) | (s > 1) | F.isnan(s),
                     F.raise_error(F.lit("Some scores are not between 0 and 1"))).otherwise(s)
    return j.withColumn("score", checked.cast("double"))
