"""Ensemble search.

Every round scores *all* candidate sets in one Spark job over one table: the
document rows of :mod:`subjex.operators.matrix`, written once. A set of members is a
vector of weights, so the running state of a search is a few numbers on the
driver (W4: the positional loop is a driver loop of one job per round; U3: remaining
candidates = members minus the chain; J9: the pairwise full join of the
fusion is a weighted sum over a pair's members). A candidate is scored by its difference to the
round's base, on the documents of its own member.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.functions.scores import clip01, stable_round
from subjex.operators import evaluate as V
from subjex.operators.matrix import Ensembles, MemberMatrix, areas, member_matrix


def member_name(model="model", prompt="prompt"):
    return F.concat_ws("_", F.col(model), F.col(prompt))


def member_scores(pred: DataFrame, score: str = "score") -> DataFrame:
    """(member, doc_id, label_id, score), one row per member pair (max)."""
    return pred.select(member_name().alias("member"), "doc_id", "label_id", F.col(score).alias("score")) \
        .groupBy("member", "doc_id", "label_id").agg(F.max("score").alias("score"))


def candidate_auc(gold: DataFrame, sets: DataFrame, steps: int = 100) -> DataFrame:
    """PR-AUC of every candidate set: ``sets`` holds (candidate, doc_id, label_id, score)."""
    grid = V.pr_grid(gold, sets, by=["candidate"], steps=steps)
    return V.pr_auc(V.pr_curve(grid, by=["candidate"]), by=["candidate"])


def best_of(auc: DataFrame, largest: bool = True) -> tuple[str, float]:
    """Argmax (ties: smallest name). One row reaches the driver."""
    key = stable_round(F.col("pr_auc"), 9)
    row = auc.orderBy(F.desc(key) if largest else F.asc(key), "candidate").first()
    return row["candidate"], float(row["pr_auc"])


def _prepare(pred: DataFrame, gold: DataFrame, score: str, start: Sequence[str] | None = None) -> MemberMatrix:
    """The members' scores by document, written once for all rounds."""
    m = member_scores(pred, score).withColumn("score", stable_round(F.col("score"), 9))
    if start is not None:
        m = m.where(F.col("member").isin(list(start)))
    return member_matrix(m, gold.select("doc_id", "label_id"))


def _round(matrix: MemberMatrix, candidates: Sequence[str], base: np.ndarray, change: float, divide: float, steps: int, clip: bool = False) -> tuple[str, float]:
    """The candidate whose member's weight, changed by ``change``, gives the best area."""
    own = [matrix.at[c] for c in candidates]
    weights = np.repeat(base[None, :], len(own), axis=0)
    weights[np.arange(len(own)), own] += change
    e = Ensembles(list(candidates), weights, np.full(len(own), float(divide)), clip, base if base.any() else None, own)
    return best_of(areas(matrix, e, steps))


def greedy_forward(pred: DataFrame, gold: DataFrame, rounds: int = 70, weights: str = "equal",
                   steps: int = 100, score: str = "score") -> DataFrame:
    """Add, round by round, the member whose addition gives the best PR-AUC.

    ``weights="equal"``: a candidate set is the plain mean of its members.
    ``weights="recurrent"``: every remaining member's table is fused with the new pick's (already fused)
    table with weight n each round, so early picks weigh more. Written out, a table is then its own
    member times a factor that shrinks with the rounds, plus a sum over the picks that all tables share; so
    both modes are a base of weights plus one member.
    Returns (model_prompt, cum_score) in pick order.
    """
    if weights not in ("equal", "recurrent"):
        raise ValueError("weights must be 'equal' or 'recurrent'")
    matrix = _prepare(pred, gold, score)
    chain: list[tuple[str, float]] = []
    base, own = np.zeros(len(matrix.members)), 1.0
    for n in range(1, min(rounds, len(matrix.members)) + 1):
        remaining = [m for m in matrix.members if m not in {c for c, _ in chain}]
        chain.append(_round(matrix, remaining, base, own, n if weights == "equal" else 1, steps))
        if weights == "equal":
            base[matrix.at[chain[-1][0]]] += 1.0
        else:  # (own x + base + n (own pick + base)) / (n + 1)
            base[matrix.at[chain[-1][0]]] += n * own / (n + 1)
            own /= n + 1
    return pred.sparkSession.createDataFrame(chain, "model_prompt string, cum_score double")


def greedy_backward(pred: DataFrame, gold: DataFrame, start: Sequence[str] | None = None,
                    rounds: int = 50, steps: int = 100, score: str = "score") -> tuple[float, DataFrame]:
    """O7 + O8: from the start set, remove round by round the member whose
    removal leaves the best PR-AUC (no stop rule).

    The fused set is the mean of the members' scores (A13). Instead of the
    lossy update (n x - y) / (n - 1) the sum over the remaining members is taken
    anew; the clip to [0, 1] and the drop of scores within 1e-10 of zero are kept.
    Returns (initial PR-AUC, chain of (model_prompt, score)).
    """
    matrix = _prepare(pred, gold, score, start)
    current, base = list(matrix.members), np.ones(len(matrix.members))
    _, initial = best_of(areas(matrix, Ensembles(["all"], base[None, :], np.array([float(len(current))])), steps))
    chain: list[tuple[str, float]] = []
    while len(chain) < rounds and len(current) > 1:
        chain.append(_round(matrix, current, base, -1.0, len(current) - 1, steps, clip=True))
        base[matrix.at[chain[-1][0]]] = 0.0
        current.remove(chain[-1][0])
    return initial, pred.sparkSession.createDataFrame(chain, "model_prompt string, score double")


def sample_ensembles(existing: DataFrame, n: int, max_big: int = 3, samples: int = 10,
                     seed: int = 0) -> DataFrame:
    """O2: ``samples`` random candidate ensembles of n members, at most
    ``max_big`` from big models (capped by what exists and by n; n capped when
    the small members are too few). Seeded; identical draws collapse into one
    candidate. The order of a draw is the MD5 sum of "seed|draw|model|prompt", so any engine can
    repeat it. ``existing``: (model, prompt, is_big), one row per member.
    Returns members(ensemble, model, prompt, ord)."""
    counts = existing.groupBy().agg(F.count_if(F.col("is_big")).alias("nb"),
                                    F.count_if(~F.col("is_big")).alias("ns")).first()
    nb, ns = int(counts["nb"]), int(counts["ns"])
    if n - max_big > ns:
        n = ns + max_big
    max_big = min(max_big, nb, n)
    draws = existing.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"))
    w = Window.partitionBy("draw", "is_big").orderBy(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), "model", "prompt")), "model", "prompt")
    quota = F.when(F.col("is_big"), F.lit(max_big)).otherwise(F.lit(n - max_big))
    picked = draws.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota)
    key = picked.groupBy("draw").agg(F.array_join(F.array_sort(F.collect_list(member_name())), "|").alias("ensemble"))
    members = picked.join(key, "draw").select("ensemble", "model", "prompt").distinct()
    wo = Window.partitionBy("ensemble").orderBy("model", "prompt")
    return members.withColumn("ord", F.row_number().over(wo))


def score_ensembles(pred: DataFrame, members: DataFrame, gold: DataFrame, top: int = 10,
                    steps: int = 100) -> DataFrame:
    """O3 + O4 + T5: vote every candidate ensemble (A6: clipped cosines over the number of members) and score them
    all in one reading of the predictions; the ``top`` best by PR-AUC (ties by name). The members table
    (ensembles x members, a parameter of the search) becomes the weights of the product."""
    given = members.groupBy("ensemble", member_name().alias("member")).agg(F.count(F.lit(1)).alias("n")).collect()
    used = {r["member"] for r in given}
    best = pred.groupBy(member_name().alias("member"), "doc_id", "label_id").agg(clip01(F.max("cosine_similarity")).alias("score"))
    matrix = member_matrix(best.where(F.col("member").isin(list(used))), gold.select("doc_id", "label_id"))
    names = sorted({r["ensemble"] for r in given})
    weights, size = np.zeros((len(names), len(matrix.members))), np.zeros(len(names))
    for r in given:
        e = names.index(r["ensemble"])
        size[e] += r["n"]  # a member without predictions counts in the mean
        if r["member"] in matrix.at:
            weights[e, matrix.at[r["member"]]] += r["n"]
    auc = areas(matrix, Ensembles(names, weights, size), steps).withColumnRenamed("candidate", "ensemble")
    return auc.orderBy(F.desc(stable_round(F.col("pr_auc"), 9)), "ensemble").limit(top)
