"""Ensemble vote (A5, A6, A13, J10, O1, O5): many (model, prompt) runs to one score
per (ensemble, doc, label). Ensembles are data: a ``members`` table
(ensemble, model, prompt, ord), never lists of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjex.functions.scores import clip01
from subjex.operators.mapping import best_match

MEMBER_KEY = ("model", "prompt")


def member_sizes(members: DataFrame) -> DataFrame:
    """Members with ``n`` = number of members of their ensemble."""
    return members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ensemble")))


def vote(predictions: DataFrame, members: DataFrame) -> DataFrame:
    """A5 + A6.

    Per member: best match per (doc, label) (A5; T1: the sort before
    ``last`` is a ``max_by``). U1: the members' tables are one long table. Then per (ensemble, doc,
    label): score = sum of clipped cosines / number of members (an absent
    member counts 0), term = term of the latest member in member order,
    maxima of hybrid score and cosine, count = members voting (J14: the
    count comes from the same group-by, no merge of two aggregates).

    The members table is tiny (ensembles x members) and broadcast; the
    predictions join on (model, prompt) so partition pruning applies when the
    predictions are stored partitioned by those columns.
    """
    per_member = best_match(predictions, by=MEMBER_KEY)
    m = F.broadcast(member_sizes(members))
    x = per_member.join(m, list(MEMBER_KEY), "inner")
    term_order = F.when(F.col("term").isNotNull(), F.col("ord"))
    return x.groupBy("ensemble", "doc_id", "label_id").agg(
        (F.sum(clip01(F.col("cosine_similarity"))) / F.first("n")).alias("score"),
        F.max_by("term", term_order).alias("term"),
        F.max("hybrid_score").alias("hybrid_score"),
        F.max("cosine_similarity").alias("cosine_similarity"),
        F.count(F.lit(1)).alias("count"))


def fused_mean(predictions: DataFrame, members: DataFrame, score: str = "score") -> DataFrame:
    """Plain mean of the members' ``score`` per (ensemble, doc, label)."""
    m = F.broadcast(member_sizes(members))
    x = predictions.join(m, list(MEMBER_KEY), "inner")
    return x.groupBy("ensemble", "doc_id", "label_id").agg(
        (F.sum(score) / F.first("n")).alias("score"))


def subtract_member(fused: DataFrame, member: DataFrame, n: int | Column, eps: float = 1e-10) -> DataFrame:
    """J10 + P6 + P8: the mean of ``n`` members without one of them.

    ``fused`` (doc_id, label_id, score) is the plain mean of A13, ``member``
    (doc_id, label_id, score) the one to leave out, at its largest score per
    pair; a pair it does not hold counts 0. Scores are clipped to [0, 1] and
    pairs within ``eps`` of zero go, as they were the member's alone. ``n`` is
    at least 2: a mean of no members is not defined and comes back empty."""
    single = member.groupBy("doc_id", "label_id").agg(F.max("score").alias("_y"))
    j = fused.select("doc_id", "label_id", "score").join(single, ["doc_id", "label_id"], "left")
    n = n if isinstance(n, Column) else F.lit(n)
    left = clip01(F.try_divide(n * F.col("score") - F.coalesce("_y", F.lit(0.0)), n - 1))
    return j.select("doc_id", "label_id", left.alias("score")).where(F.abs("score") > eps)


def existing_members(predictions: DataFrame, big_models: list[str] | None = None) -> DataFrame:
    """O1: (model, prompt) pairs that hold predictions, flagged big or small."""
    pairs = predictions.select(*MEMBER_KEY).distinct()
    big = F.col("model").isin(big_models or [])
    return pairs.withColumn("is_big", big)
