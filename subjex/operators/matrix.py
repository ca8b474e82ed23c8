"""Many ensembles scored in one reading of the predictions.

A document is one row: its predicted (doc, label) pairs, each with the members
that predict it and their scores, and its number of gold labels. An ensemble is a
vector of member weights, so the scores of all ensembles are the product of
a document's pair x member matrix with the member x ensemble weights. A task
multiplies a batch of documents, ranks the pairs per ensemble and adds up what every tie group
changes at its grid cell; only cell sums are shuffled.

In a search round the candidates share a base (the chosen members), so a
candidate's grid is the base's grid plus differences on those documents that the
candidate's own member predicts. The base is evaluated once for all candidates; a candidate
costs the documents of its member, not the whole set. Weights replace running
tables: nothing is copied per candidate, nothing written between rounds.

A row holds at most ``MOST`` pairs. Larger documents stay long: their pairs join the
weights and go through the grid's relational plan, which spreads one
document over many tasks; both parts add up to the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.functions.scores import clip01
from subjex.operators import evaluate as V
from subjex.session import cut_lineage

EPS = 1e-10
MOST = 20_000
MEASURES = ("prec", "rec", "f1", "has")
HIST = "candidate int, ti long, lim int, h_prec double, h_rec double, h_f1 double, h_has long"


@dataclass
class Ensembles:
    """Weights of the members by ensemble, and how a weighted sum becomes a score.

    ``divide`` is one number per ensemble. ``clip`` bounds scores to [0, 1] and drops
    those within EPS of zero (what is left of a mean after a member is taken
    out); otherwise a pair is scored as soon as a weighted member predicts it. With ``base`` the
    ensembles are candidates of one round: ``own`` is the member that each adds or takes out.
    """
    names: list[str]
    weights: np.ndarray
    divide: np.ndarray
    clip: bool = False
    base: np.ndarray | None = None
    own: list[int] = field(default_factory=list)


@dataclass
class MemberMatrix:
    members: list[str]
    rows: DataFrame
    large: DataFrame | None
    n_docs: int

    @property
    def at(self) -> dict[str, int]:
        return {m: i for i, m in enumerate(self.members)}


def member_matrix(scores: DataFrame, gold: DataFrame, most: int = MOST) -> MemberMatrix:
    """Document rows from (member, doc_id, label_id, score), one row per member and pair, and gold (doc_id, label_id).

    Gold labels meet the predictions in the group-by of the pair, so no gold set is carried to a prediction (J16).
    Documents without gold labels do not count in any measure and are left out; null and NaN scores are no predictions.
    """
    votes = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    members = [r["member"] for r in votes.select("member").distinct().orderBy("member").collect()]  # names of runs
    number = F.array_position(F.array(*map(F.lit, members)), F.col("member")) - 1 if members else F.lit(0)
    voted = votes.select("doc_id", "label_id", F.struct(number.cast("int").alias("m"), F.col("score").cast("double").alias("x")).alias("vote"), F.lit(0).alias("gold"))
    judged = gold.select("doc_id", "label_id", F.lit(None).cast(voted.schema["vote"].dataType).alias("vote"), F.lit(1).alias("gold"))
    both = voted.unionByName(judged).repartition("doc_id", "label_id")
    pairs = cut_lineage(both.groupBy("doc_id", "label_id").agg(F.collect_list("vote").alias("votes"), F.max("gold").alias("hit")))  # at most a vote per member
    sizes = pairs.groupBy("doc_id").agg(F.sum("hit").alias("n_gold"), F.count_if(F.size("votes") > 0).alias("n_pred"))
    n_docs = sizes.where("n_gold > 0").count()
    judged_docs = sizes.where("n_gold > 0 and n_pred > 0")
    over = judged_docs.where(F.col("n_pred") > most)
    pair = F.struct("hit", "votes")
    if over.isEmpty():
        large, small = None, pairs
    else:
        large = cut_lineage(pairs.where(F.size("votes") > 0).join(over.select("doc_id", "n_gold"), "doc_id").select("doc_id", "label_id", "n_gold", F.col("hit").alias("_hit"), "votes"))
        small = pairs.join(over.select("doc_id"), "doc_id", "left_anti")
    rows = (small.groupBy("doc_id").agg(F.sum("hit").alias("n_gold"), F.collect_list(F.when(F.size("votes") > 0, pair)).alias("pairs"))
            .where((F.col("n_gold") > 0) & (F.size("pairs") > 0)).select("n_gold", "pairs"))
    return MemberMatrix(members, cut_lineage(rows), large, n_docs)


def _rounded(x: np.ndarray) -> np.ndarray:
    """`stable_round` at nine digits, by the same operations."""
    pre = np.floor(x * 1e9 + 0.5) / 1e9
    return np.where(np.abs(x) >= 9e9, x, np.floor(pre * 1e9 + 0.5) / 1e9)


def threshold_indexes(score: np.ndarray, steps: int) -> np.ndarray:
    """`threshold_index` on arrays."""
    i = np.floor(score * float(steps)).astype(np.int64)
    i = np.where((i + 1) / steps <= score, i + 1, np.where(i / steps > score, i - 1, i))
    return np.where(score < 0, -1, np.minimum(steps, i))


def cell_changes(doc: np.ndarray, score: np.ndarray, hit: np.ndarray, n_gold: np.ndarray, steps: int) -> tuple[np.ndarray, ...]:
    """(doc, ti, lim, changes) of every tie group: what it adds to precision, recall, F1 and predicted documents.

    ``doc`` numbers the document of each pair; ``n_gold`` is by that number."""
    order = np.lexsort((-score, doc))
    d, s, h = doc[order], score[order], hit[order]
    if not len(d):
        return d, d, d, np.zeros((0, 4))
    new_doc = np.append(True, d[1:] != d[:-1])
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d))
    begin = np.maximum.accumulate(np.where(new_doc, np.arange(len(d)), 0))[first]
    upto = np.append(0, np.cumsum(h))
    pn, cn = first - begin, last - begin
    ptp, ctp = upto[first] - upto[begin], upto[last] - upto[begin]
    ng = n_gold[d[first]].astype(np.float64)
    started = pn > 0
    pn_ = np.where(started, pn, 1)
    change = np.stack([ctp / cn - np.where(started, ptp / pn_, 0.0), ctp / ng - np.where(started, ptp / ng, 0.0),
                       2 * ctp / (cn + ng) - np.where(started, 2 * ptp / (pn_ + ng), 0.0), (~started).astype(np.float64)], axis=1)
    ti = threshold_indexes(s[first], steps)
    keep = ti >= 0
    return d[first][keep], ti[keep], (pn + 1)[keep], change[keep]


class _Batch:
    """Documents of one Arrow batch as flat arrays: pairs by document, votes by pair."""

    def __init__(self, b: pa.RecordBatch, n_members: int):
        pairs = b.column("pairs")
        flat = pairs.flatten()
        n_pairs = pairs.value_lengths().to_numpy()
        self.n_gold = b.column("n_gold").to_numpy()
        self.doc = np.repeat(np.arange(b.num_rows), n_pairs)
        self.hit = flat.field("hit").to_numpy().astype(np.int64)
        votes = flat.field("votes")
        vote = votes.flatten()
        self.pair = np.repeat(np.arange(len(flat)), votes.value_lengths().to_numpy())
        self.member, self.x = vote.field("m").to_numpy(), vote.field("x").to_numpy()
        # documents that each member predicts
        self.docs_of = np.zeros((n_members, b.num_rows), bool)
        self.docs_of[self.member, self.doc[self.pair]] = True

    def scores(self, weights: np.ndarray, divide: float, clip: bool, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(pairs that are scored, their scores) under one weight vector, within the picked documents."""
        w = weights[self.member]
        on = w != 0 if pick is None else (w != 0) & pick[self.doc[self.pair]]
        total = np.bincount(self.pair[on], weights=self.x[on] * w[on], minlength=len(self.doc))
        score = _rounded(total / divide)
        if clip:
            # bounds first, then what is near zero goes, then the rounding that ties share
            bounded = np.clip(total / divide, 0.0, 1.0)
            there = np.abs(bounded) > EPS
            score = _rounded(bounded)
        else:
            there = np.zeros(len(self.doc), bool)
            there[self.pair[on]] = True
        if pick is not None:
            there &= pick[self.doc]
        return np.flatnonzero(there), score

    def changes(self, weights: np.ndarray, divide: float, clip: bool, steps: int, pick: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        at, score = self.scores(weights, divide, clip, pick)
        return cell_changes(self.doc[at], score[at], self.hit[at], self.n_gold, steps)


class _Cells:
    """Sums by (candidate, ti, lim) of one task."""

    def __init__(self, steps: int):
        self.steps, self.keys, self.sums = steps, [], []

    def add(self, candidate: int, ti: np.ndarray, lim: np.ndarray, change: np.ndarray, sign: int = 1) -> None:
        key, back = np.unique(lim * (self.steps + 1) + ti, return_inverse=True)
        self.keys.append(np.stack([np.full(len(key), candidate), key % (self.steps + 1), key // (self.steps + 1)], axis=1))
        self.sums.append(sign * np.stack([np.bincount(back, weights=change[:, k], minlength=len(key)) for k in range(4)], axis=1))

    def batch(self) -> pa.RecordBatch:
        keys = np.concatenate(self.keys or [np.zeros((0, 3), np.int64)])
        sums = np.concatenate(self.sums or [np.zeros((0, 4))])
        self.keys, self.sums = [], []
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int64()), pa.array(keys[:, 2], pa.int32()),
                                           *(pa.array(sums[:, k], pa.float64()) for k in range(3)), pa.array(np.rint(sums[:, 3]), pa.int64())],
                                          names=["candidate", "ti", "lim", *(f"h_{m}" for m in MEASURES)])


def small_hist(rows: DataFrame, e: Ensembles, steps: int) -> DataFrame:
    """Cell sums of the document rows. With a base, candidate -1 is the base and the others are differences to it."""
    n_members = e.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            docs, cells = _Batch(b, n_members), _Cells(steps)
            if e.base is not None:
                # all candidates of a round share the divisor
                d, ti, lim, change = docs.changes(e.base, e.divide[0], e.clip, steps)
                cells.add(-1, ti, lim, change)
            for k in range(len(e.names)):
                pick = docs.docs_of[e.own[k]] if e.base is not None else None
                if pick is not None:
                    if not pick.any():
                        continue
                    was = pick[d]
                    cells.add(k, ti[was], lim[was], change[was], -1)
                _, ti_k, lim_k, change_k = docs.changes(e.weights[k], e.divide[k], e.clip, steps, pick)
                cells.add(k, ti_k, lim_k, change_k)
            yield cells.batch()
    return rows.mapInArrow(run, HIST)


def large_hist(large: DataFrame, e: Ensembles, steps: int) -> DataFrame:
    """Cell sums of the documents too large for a row: their votes meet the weights (ensembles x members, given by
    parameter) and go through the relational grid."""
    spark = large.sparkSession
    w = spark.createDataFrame([(k, m, float(x), float(e.divide[k])) for k, row in enumerate(e.weights) for m, x in enumerate(row) if x], "candidate int, m int, w double, n double")
    votes = large.select("doc_id", "label_id", "n_gold", "_hit", F.inline("votes"))
    scored = votes.join(F.broadcast(w), "m").groupBy("candidate", "doc_id", "label_id").agg(
        (F.sum(F.col("x") * F.col("w")) / F.first("n")).alias("score"), F.first("n_gold").alias("n_gold"), F.first("_hit").alias("_hit"))
    if e.clip:
        scored = scored.withColumn("score", clip01(F.col("score"))).where(F.abs("score") > EPS)
    changes = V.tie_changes(scored, ["candidate", "doc_id"], steps)
    return changes.groupBy("candidate", "ti", "lim").agg(*(F.sum(f"h_{m}").alias(f"h_{m}") for m in MEASURES))


def grid_area(ti: np.ndarray, lim: np.ndarray, sums: np.ndarray, n_docs: int, steps: int) -> float | None:
    """PR-AUC from the cell sums of one ensemble: the grid's cumulative sums, its curve and the curve's step area."""
    lims, at = np.unique(lim, return_inverse=True)
    grid = np.zeros((steps + 1, len(lims), 4))
    np.add.at(grid, (ti, at.reshape(-1)), sums)
    grid = np.cumsum(np.cumsum(grid, axis=1)[::-1], axis=0)
    has = np.rint(grid[..., 3])
    there = has > 0
    recall, precision = _rounded(grid[..., 1][there] / n_docs), _rounded(grid[..., 0][there] / has[there])
    if not len(recall):
        return None
    order = np.lexsort((precision, recall))
    recall, precision = recall[order], precision[order]
    last = np.append(recall[1:] != recall[:-1], True)  # the greatest precision of each recall
    recall, best = recall[last], np.maximum.accumulate(precision[last][::-1])[::-1]
    return float((np.diff(np.append(0.0, recall)) * best).sum())


def areas(matrix: MemberMatrix, e: Ensembles, steps: int = 100) -> DataFrame:
    """(candidate, pr_auc) of every ensemble that predicts a gold document."""
    spark = matrix.rows.sparkSession
    sums = [F.sum(f"h_{m}").alias(f"h_{m}") for m in MEASURES]
    hist = small_hist(matrix.rows, e, steps).groupBy("candidate", "ti", "lim").agg(*sums)
    if e.base is not None:  # the base's cells count for every candidate: grid rows, not predictions
        each = F.explode(F.when(F.col("candidate") < 0, F.sequence(F.lit(0), F.lit(len(e.names) - 1))).otherwise(F.array("candidate")))
        hist = hist.select(each.alias("candidate"), "ti", "lim", *(f"h_{m}" for m in MEASURES))
    if matrix.large is None:  # limits end at the largest row, so an ensemble's grid fits one task
        n_docs, names = matrix.n_docs, e.names

        def area(t: pa.Table) -> pa.Table:
            found = grid_area(*(t.column(c).to_numpy() for c in ("ti", "lim")), np.stack([t.column(f"h_{m}").to_numpy().astype(float) for m in MEASURES], axis=1), n_docs, steps)
            kept = [] if found is None else [found]
            return pa.table([pa.array([names[t.column("candidate")[0].as_py()]] * len(kept), pa.string()), pa.array(kept, pa.float64())], names=["candidate", "pr_auc"])
        return hist.groupBy("candidate").applyInArrow(area, "candidate string, pr_auc double")
    hist = hist.unionByName(large_hist(matrix.large, e, steps).select(*hist.columns)).groupBy("candidate", "ti", "lim").agg(*sums)
    numbered = F.broadcast(spark.createDataFrame(list(enumerate(e.names)), "number int, name string"))  # a row per ensemble
    grid = V.grid_of(hist, ["candidate"], steps, F.lit(matrix.n_docs))
    auc = V.pr_auc(V.pr_curve(grid, by=["candidate"]), by=["candidate"])
    return auc.join(numbered, F.col("candidate") == F.col("number")).select(F.col("name").alias("candidate"), "pr_auc")
