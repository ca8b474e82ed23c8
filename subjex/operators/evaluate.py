"""Evaluation (E1-E9, S7, W1, W2, A17): document-averaged set scores, strata,
precision-recall grid, curve, area and best cut-off.

Every function takes a ``by`` tuple of key columns (an ensemble, a candidate, a
model and prompt...) so that one Spark job scores many prediction sets at once.

Gold is never replicated per key: documents that a key does not predict
contribute 0 to recall and F1, so those two divide by the number of gold
documents (a per-stratum constant), while precision and R-precision divide by
the documents that hold a prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.functions.scores import safe_ratio, stable_round
from subjex.session import ROWS_PER_TASK, cut_lineage

STRATA = ("language", "text_type")
METRICS = ("prec", "rec", "f1", "rprec")


# ---------------------------------------------------------------- gold

GND_PATTERN = r"(gnd:[0-9X-]+)"


def gold_from_dataset(dataset: DataFrame, subject_col: str = "dcterms:subject",
                      doc_col: str = "doc_id", keep: Sequence[str] = STRATA) -> DataFrame:
    """S7 + U4 + U5: a stringified subject list (``"['gnd:1', 'gnd:2-3']"``) to long gold rows.

    Each comma piece contributes its first identifier; pieces without one are
    left out (count them with :func:`count_unparsed_pieces`).
    """
    pieces = F.split(F.col(f"`{subject_col}`"), ",", -1)
    ids = F.filter(F.transform(pieces, lambda p: F.regexp_extract(p, GND_PATTERN, 1)),
                   lambda x: x != "")
    return (dataset.select(F.col(doc_col).alias("doc_id"), F.explode(ids).alias("label_id"),
                           *[F.col(k) for k in keep])
            .distinct())


def count_unparsed_pieces(dataset: DataFrame, subject_col: str = "dcterms:subject") -> DataFrame:
    pieces = F.split(F.col(f"`{subject_col}`"), ",", -1)
    bad = F.size(F.filter(pieces, lambda p: F.regexp_extract(p, GND_PATTERN, 1) == ""))
    return dataset.agg(F.sum(bad).cast("long").alias("n_unparsed"))


# ------------------------------------------------------------- ranks

SCORE_BINS = 1024


def _score_bin(score):
    """A bucket that grows with the score (scores outside [0, 1] share the
    two edge buckets)."""
    return F.least(F.lit(SCORE_BINS), F.greatest(F.lit(-1), F.floor(score * SCORE_BINS))).cast("int")


def doc_prefix(ties: DataFrame, keys: Sequence[str], cols: Sequence[str], score: str = "score") -> DataFrame:
    """For rows of distinct (keys, score), the sums of ``cols`` over the
    strictly higher scores of the same keys, as ``above_<col>``.

    No window spans a whole document (a hot document may hold a third of all
    rows): per (document, score bucket) totals are summed by a window over at
    most SCORE_BINS + 2 buckets, and a window inside (document, bucket) adds
    the higher scores of the same bucket."""
    t = ties.withColumn("_bin", _score_bin(F.col(score)))
    bins = t.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(f"_b{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", *[F.coalesce(F.sum(f"_b{c}").over(wb), F.lit(0)).alias(f"_pb{c}")
                                        for c in cols])
    wi = Window.partitionBy(*keys, "_bin").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_pi{c}") for c in cols])
    return t.join(bins, [*keys, "_bin"], "inner").select(
        *ties.columns, *[(F.col(f"_pb{c}") + F.col(f"_pi{c}")).alias(f"above{c}") for c in cols])


#: Predictions of a document up to which one task ranks it as a whole.
WHOLE_DOC = 20_000


def by_document_size(pred: DataFrame, limit: int = WHOLE_DOC) -> tuple[DataFrame, DataFrame | None]:
    """(small, large): the predictions of documents of up to ``limit`` rows, dealt out by document, and all others (of no
    document too), dealt out by document and label; None where there are none.

    What is grouped by document and more keys needs no other shuffle on the small side. A large document holds more than
    ``limit`` rows, so the list of those is bounded by the rows over it."""
    spark = pred.sparkSession
    hot = cut_lineage(pred.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > limit) | F.col("doc_id").isNull()).select("doc_id"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-pred.count() // ROWS_PER_TASK))
    if hot.isEmpty():
        return pred.repartition(tasks, "doc_id"), None
    same = pred["doc_id"].eqNullSafe(hot["doc_id"])
    return (pred.join(F.broadcast(hot), same, "left_anti").repartition(tasks, "doc_id"),
            pred.join(F.broadcast(hot), same, "left_semi").repartition(tasks, "doc_id", "label_id"))


def rank_predictions(pred: DataFrame, by: Sequence[str] = (), score: str = "score", whole: bool = False) -> DataFrame:
    """``min_rank(desc(score))`` per document (ties share the lowest rank).

    rank = 1 + number of the document's predictions with a higher score,
    computed on the distinct scores (repeated scores collapse in a partial
    aggregate) with :func:`doc_prefix`, so no task holds a whole document;
    the rank returns to the rows by an equi-join that AQE can split.
    With ``whole`` the documents are small (see :func:`by_document_size`) and a window per document ranks the rows in
    place: they are shuffled by document once, or not at all where they are dealt out so.
    """
    keys = [*by, "doc_id"]
    if whole:
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score))).cast("int")
        none = F.greatest(*[F.col(c).isNull() for c in (*keys, score)])  # no rank, as no such row meets itself in a join
        return pred.select(*keys, score, *[c for c in pred.columns if c not in (*keys, score)], F.when(~none, rank).alias("rank"))
    ties = pred.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    ranks = doc_prefix(ties, keys, ["_n"], score).select(
        *keys, score, (F.col("above_n") + 1).cast("int").alias("rank"))
    return pred.join(ranks, on=[*keys, score], how="left")


def cut(pred: DataFrame, limit: int | None = None, threshold: float | None = None) -> DataFrame:
    """Keep ``rank <= limit`` and ``score >= threshold``."""
    cond = F.lit(True)
    if limit is not None:
        cond = cond & (F.col("rank") <= limit)
    if threshold is not None:
        cond = cond & (F.col("score") >= threshold)
    return pred.where(cond)


# ------------------------------------------------------ matching

def unpredicted_docs(gold: DataFrame, pred: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Gold documents without any prediction; with ``members`` (ensemble, model, prompt) the (ensemble, doc_id)
    that no member of the ensemble predicts."""
    docs = gold.select("doc_id").distinct()
    if members is None:
        return docs.join(pred.select("doc_id").distinct(), "doc_id", "left_anti")
    m = members.select("ensemble", "model", "prompt").distinct()
    p = pred.select(F.col("model").alias("_m"), F.col("prompt").alias("_p"), "doc_id").distinct()
    predicted = p.join(F.broadcast(m), F.col("_m").eqNullSafe(F.col("model")) & F.col("_p").eqNullSafe(F.col("prompt"))).select("ensemble", "doc_id").distinct()
    return docs.crossJoin(F.broadcast(m.select("ensemble").distinct())).join(predicted, ["ensemble", "doc_id"], "left_anti").select("ensemble", "doc_id")


def match_docs(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep documents present on both sides (the second semi join uses the
    already reduced gold, as the reference does)."""
    g = gold.join(pred.select("doc_id").distinct(), "doc_id", "left_semi")
    p = pred.join(g.select("doc_id").distinct(), "doc_id", "left_semi")
    return g, p


# ------------------------------------------------------ per-document counts

def gold_docs(gold: DataFrame, strata: Sequence[str] = STRATA) -> DataFrame:
    """One row per gold document: ``n_gold`` and its strata."""
    return gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold"),
                                      *[F.first(s, ignorenulls=True).alias(s) for s in strata])


def doc_counts(gold: DataFrame, pred: DataFrame, by: Sequence[str] = (),
               strata: Sequence[str] = STRATA, include_unjudged: bool = False) -> DataFrame:
    """E1 + J16: ``tp, n_pred, n_gold`` for every (key, predicted document).

    Predictions are made distinct on (key, doc, label) first. Documents
    predicted but not in gold are dropped unless ``include_unjudged``.
    """
    keys = [*by, "doc_id"]
    # a pair meets gold by document and label, so a large document is spread over its labels; counts are partial
    # before they are shuffled by document
    pairs = pred.select(*keys, "label_id").repartition("doc_id", "label_id").distinct()
    hits = pairs.join(gold_pairs(gold).withColumn("_hit", F.lit(1)), ["doc_id", "label_id"], "left")
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("tp"))
    per_label = gold.groupBy("doc_id", "label_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in strata])
    docs = per_label.groupBy("doc_id").agg(F.count("label_id").alias("n_gold"), *[F.first(c, ignorenulls=True).alias(c) for c in strata])
    out = counts.join(docs, "doc_id", "left" if include_unjudged else "inner")
    return out.select(*keys, "n_pred", "tp", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), *strata)


def gold_pairs(gold: DataFrame) -> DataFrame:
    """The distinct (doc_id, label_id) of gold."""
    return gold.select("doc_id", "label_id").where("label_id is not null").distinct()


def with_strata(gold: DataFrame) -> DataFrame:
    """Gold without strata columns counts as one stratum 'all'."""
    return gold.select("*", *[F.lit("all").alias(s) for s in STRATA if s not in gold.columns])


def _doc_measures(df: DataFrame) -> DataFrame:
    tp, npred, ngold = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    return df.select(
        "*",
        safe_ratio(tp, npred).alias("_prec"),
        F.coalesce(safe_ratio(tp, ngold), F.lit(0.0)).alias("_rec"),
        F.coalesce(safe_ratio(2 * tp, npred + ngold), F.lit(0.0)).alias("_f1"),
        safe_ratio(tp, F.least(ngold, npred)).alias("_rprec"),
        F.when(npred > 0, 1).otherwise(0).alias("_has"),
    )


def _strata_groups(df: DataFrame, by: Sequence[str], strata: Sequence[str], aggs: list) -> DataFrame:
    """Overall, per stratum column, per combination; unused key = 'all'."""
    missing = [F.lit("all").alias(s) for s in STRATA if s not in strata]
    if not strata:
        return df.groupBy(*by).agg(*aggs).select("*", *missing)
    # every grouping set keeps the by-columns; the strata vary (= cube over strata)
    out = df.groupingSets([[*by, *c] for c in _subsets(strata)], *by, *strata) \
        .agg(*aggs, *[F.grouping(s).alias(f"_g_{s}") for s in strata])
    labelled = [F.when(F.col(f"_g_{s}") == 1, F.lit("all")).otherwise(F.col(s)).alias(s) for s in strata]
    return out.select(*by, *labelled, *missing,
                      *[c for c in out.columns if c not in (*by, *strata) and not c.startswith("_g_")])


def _all_strata(sums: DataFrame, denom: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every gold stratum for every key, also where the key predicts none of
    its documents (recall and F1 0 there, precision NULL). The strata list is
    small (the cube of two low-cardinality columns) and rides along as a
    scalar subquery; the keys come from the predictions."""
    if not by:
        return F.broadcast(denom).join(sums, list(STRATA), "left")
    strata_arr = denom.select(F.collect_list(F.struct(*STRATA))).scalar()
    keys = sums.select(*by).distinct().select(*by, F.explode(strata_arr).alias("_s")) \
        .select(*by, *[F.col(f"_s.{c}").alias(c) for c in STRATA])
    return keys.join(sums, [*by, *STRATA], "left").join(F.broadcast(denom), list(STRATA), "left")


def _subsets(cols: Sequence[str]) -> list[list[str]]:
    res: list[list[str]] = [[]]
    for c in cols:
        res += [r + [c] for r in res]
    return res


def set_scores(gold: DataFrame, pred: DataFrame, by: Sequence[str] = (),
               strata: Sequence[str] = (), mode: str = "doc-avg",
               include_unjudged: bool = False) -> DataFrame:
    """E2-E6 (+A17 when ``strata`` is given): long rows ``metric, value``.

    A16: E2 precision, E3 recall, E4 F1 (mean of per-document F1), E5
    R-precision tp / min(n_gold, n_pred); U5: wide measures to long rows.

    doc-avg: precision and R-precision average over documents with at least one
    prediction, recall and F1 over all gold documents (0 when unpredicted).
    micro: sums of true positives over sums of predictions / gold labels.
    """
    gold = with_strata(gold)
    counts = doc_counts(gold, pred, by, STRATA, include_unjudged)
    gd = gold_docs(gold, STRATA)
    if mode == "doc-avg":
        m = _doc_measures(counts)
        aggs = [F.sum("_prec").alias("s_prec"), F.sum("_rec").alias("s_rec"),
                F.sum("_f1").alias("s_f1"), F.sum("_rprec").alias("s_rprec"),
                F.sum("_has").alias("n_has")]
        sums = _strata_groups(m, by, strata, aggs)
        denom = _strata_groups(gd, (), strata, [F.count(F.lit(1)).alias("n_docs")])
        if include_unjudged:
            extra = _strata_groups(counts.where(F.col("n_gold") == 0), by, strata,
                                   [F.count(F.lit(1)).alias("n_extra")])
            sums = sums.join(extra, [*by, *STRATA], "left")
        res = _all_strata(sums, denom, by).na.fill(0.0, ["s_prec", "s_rec", "s_f1", "s_rprec"]) \
            .na.fill(0, ["n_has"])
        n_all = F.col("n_docs") + (F.coalesce(F.col("n_extra"), F.lit(0)) if include_unjudged else F.lit(0))
        vals = {
            "prec": safe_ratio(F.col("s_prec"), F.col("n_has")),
            "rec": safe_ratio(F.col("s_rec"), n_all),
            "f1": safe_ratio(F.col("s_f1"), n_all),
            "rprec": safe_ratio(F.col("s_rprec"), F.col("n_has")),
        }
    elif mode == "micro":
        aggs = [F.sum("tp").alias("s_tp"), F.sum("n_pred").alias("s_pred")]
        sums = _strata_groups(counts, by, strata, aggs)
        denom = _strata_groups(gd, (), strata, [F.sum("n_gold").alias("s_gold")])
        res = _all_strata(sums, denom, by).na.fill(0, ["s_tp", "s_pred"])
        p = safe_ratio(F.col("s_tp"), F.col("s_pred"))
        r = safe_ratio(F.col("s_tp"), F.col("s_gold"))
        vals = {"prec": p, "rec": r, "f1": safe_ratio(2 * p * r, p + r),
                "rprec": safe_ratio(F.col("s_tp"), F.least(F.col("s_gold"), F.col("s_pred")))}
    else:
        raise ValueError("mode must be 'doc-avg' or 'micro'")
    metric_rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value"))
                                      for k, v in vals.items()]))
    return res.select(*by, *STRATA, metric_rows.alias("_m")).select(*by, "_m.metric", "_m.value", *STRATA)


def strata_scores(gold: DataFrame, pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Set scores overall, by language, by text type and by both."""
    return set_scores(gold, pred, by=by, strata=STRATA)


# ------------------------------------------------- PR grid

def threshold_index(score, steps: int):
    """Largest i in [0, steps] with ``i / steps <= score``; -1 below 0.

    Computed by floor and then corrected against the literal threshold so that
    it agrees exactly with the comparison ``score >= i / steps``.
    """
    i0 = F.floor(score * F.lit(float(steps))).cast("long")
    i1 = (F.when((i0 + 1).cast("double") / steps <= score, i0 + 1)
          .when(i0.cast("double") / steps > score, i0 - 1)
          .otherwise(i0))
    return F.when(score < 0, F.lit(-1)).otherwise(F.least(F.lit(steps).cast("long"), i1))


def gold_sizes(gold: DataFrame) -> DataFrame:
    """Number of labels of each gold document."""
    return gold.select("doc_id", "label_id").distinct().groupBy("doc_id").agg(F.count("label_id").alias("n_gold"))


def pr_grid(gold: DataFrame, pred: DataFrame, by: Sequence[str] = (), steps: int = 100,
            ordinal: bool = False, dense: bool = True) -> DataFrame:
    """Doc-averaged precision, recall and F1 at every cell (threshold, limit).

    A cell keeps ``rank <= limit and score >= threshold``; thresholds are
    ``i / steps`` (i = 0..steps), limits 1..max predictions of a document; with
    ``ordinal`` only the limits (threshold 0).

    Rather than re-evaluating every cell, each tie group j of a document (its
    predictions of equal score) adds the change of the document's metrics,
    v_j - v_(j-1), at the cell (threshold index, rank) where it first enters;
    a two-dimensional cumulative sum (thresholds downward, limits upward) then
    yields the sum over documents at every cell. Work: O(predictions) plus the
    grid, not predictions x cells.

    Shuffles: the predictions move by (document, label) to meet gold, then by document for
    its number of labels; tie groups reuse that partitioning. Tie groups are summed per cell before the shuffle; the
    grid of a key is dealt out by threshold, then by limit, so no task holds
    a whole grid.
    """
    n_docs = gold.select(F.count_distinct("doc_id")).scalar()
    return pr_grid_tagged(tag_predictions(pred, gold, by), by, steps, ordinal, n_docs, dense)


def tag_predictions(pred: DataFrame, gold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Predictions as a set per (key, doc, label) (max score, at 1e-9), each
    with ``_hit`` (the pair is in gold) and ``n_gold`` (NULL for documents outside gold)."""
    keys = [*by, "doc_id"]
    p = pred.where(F.col("score").isNotNull() & ~F.isnan("score")) \
        .select(*keys, "label_id", stable_round(F.col("score"), 9).alias("score")).repartition("doc_id", "label_id")
    uniq = p.groupBy(*keys, "label_id").agg(F.max("score").alias("score"))
    tagged = uniq.join(gold_pairs(gold).withColumn("_hit", F.lit(1)), ["doc_id", "label_id"], "left")
    return tagged.join(gold_sizes(gold), "doc_id", "left").select(*keys, "label_id", "score", "n_gold", F.coalesce("_hit", F.lit(0)).alias("_hit"))


def pr_grid_tagged(uniq: DataFrame, by: Sequence[str], steps: int = 100, ordinal: bool = False,
                   n_docs=None, dense: bool = True) -> DataFrame:
    """The grid from tagged predictions (see :func:`tag_predictions`);
    ``n_docs`` = number of gold documents (a number or a scalar column).

    ``dense=False`` keeps only the limits at which some tie group enters: the
    grid is constant between them, so curve, area and best cut-off (smallest
    limit among equal cells) are unchanged, and the grid no longer grows with
    the largest document."""
    from pyspark.sql import Column
    n_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    keys = [*by, "doc_id"]
    uniq = uniq.withColumn("score", stable_round(F.col("score"), 9))  # idempotent
    ties = uniq.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_tp"),
                                            F.first("n_gold").alias("n_gold"))
    # Max predictions per document over every predicted document (gives the limits)
    max_preds = ties.groupBy(*keys).agg(F.sum("_n").alias("_cnt")) \
        .groupBy(*by).agg(F.max("_cnt").cast("int").alias("max_preds"))
    d = _tie_group_changes(ties, keys, steps, ordinal).drop("doc_id")

    n_thr = 0 if ordinal else steps
    if dense:
        lims = max_preds.select(*by, F.explode(F.sequence(F.lit(1), F.col("max_preds"))).alias("lim"))
    else:
        lims = d.select(*by, "lim").distinct()
    cells = lims.select(*by, "lim", F.explode(F.sequence(F.lit(0), F.lit(n_thr))).alias("ti"))
    cells = cells.select(*by, F.col("ti").cast("long").alias("ti"), "lim",
                         *[F.lit(0.0).alias(f"h_{m}") for m in ("prec", "rec", "f1")], F.lit(0).alias("h_has"))
    sums = [F.sum(f"h_{m}").alias(f"h_{m}") for m in ("prec", "rec", "f1", "has")]
    hist = d.groupBy(*by, "ti", "lim").agg(*sums)  # summed before it is dealt out: at most a row per cell and task
    return _cumulated(hist, cells, by, steps, ordinal, n_docs)


def tie_changes(uniq: DataFrame, keys: Sequence[str], steps: int = 100, ordinal: bool = False) -> DataFrame:
    """(keys, lim, ti, h_prec, h_rec, h_f1, h_has): what each tie group of tagged predictions adds at its cell."""
    uniq = uniq.withColumn("score", stable_round(F.col("score"), 9))
    ties = uniq.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_tp"), F.first("n_gold").alias("n_gold"))
    return _tie_group_changes(ties, keys, steps, ordinal)


def grid_of(hist: DataFrame, by: Sequence[str], steps: int = 100, n_docs=None, ordinal: bool = False) -> DataFrame:
    """The grid from summed changes (by, ti, lim, h_*), at the limits that occur; it is constant between them."""
    cells = hist.select(*by, "lim").distinct().select(*by, "lim", F.explode(F.sequence(F.lit(0), F.lit(0 if ordinal else steps))).alias("ti"))
    cells = cells.select(*by, F.col("ti").cast("long").alias("ti"), "lim",
                         *[F.lit(0.0).alias(f"h_{m}") for m in ("prec", "rec", "f1")], F.lit(0).alias("h_has"))
    return _cumulated(hist, cells, by, steps, ordinal, n_docs)


def _tie_group_changes(ties: DataFrame, keys: Sequence[str], steps: int, ordinal: bool) -> DataFrame:
    """Counts above each tie group (no window spans a document), then the document's metrics after the group (v) less
    those before it (v0)."""
    j = doc_prefix(ties.where(F.col("n_gold").isNotNull()), keys, ["_n", "_tp"])
    cn, ctp = F.col("above_n") + F.col("_n"), F.col("above_tp") + F.col("_tp")
    pn, ptp, ng = F.col("above_n"), F.col("above_tp"), F.col("n_gold")
    first_group = pn == 0

    def before(v):
        return F.when(first_group, F.lit(0.0)).otherwise(v)

    deltas = [(ctp / cn - before(ptp / pn)).alias("h_prec"),
              (ctp / ng - before(ptp / ng)).alias("h_rec"),
              (2 * ctp / (cn + ng) - before(2 * ptp / (pn + ng))).alias("h_f1")]
    first = F.when(first_group, F.lit(1)).otherwise(F.lit(0)).alias("h_has")
    j = j.select(*keys, "score", (pn + 1).alias("rank"), *deltas, first)
    idx = F.lit(0).cast("long") if ordinal else threshold_index(F.col("score"), steps)
    return j.select(*keys, F.col("rank").cast("int").alias("lim"), idx.alias("ti"),
                    "h_prec", "h_rec", "h_f1", "h_has").where(F.col("ti") >= 0)


def _cumulated(hist: DataFrame, cells: DataFrame, by: Sequence[str], steps: int, ordinal: bool, n_docs) -> DataFrame:
    """Two-dimensional cumulative sums of the cell changes: thresholds downward, limits upward."""
    both = hist.select(*cells.columns).unionByName(cells).repartition(*by, "ti")  # the first cumulative sum runs there
    dense = both.groupBy(*by, "ti", "lim").agg(*[F.sum(f"h_{m}").alias(f"h_{m}")
                                                 for m in ("prec", "rec", "f1", "has")])
    w_l = Window.partitionBy(*by, "ti").orderBy("lim").rowsBetween(Window.unboundedPreceding, 0)
    step1 = dense.select(*by, "ti", "lim", *[F.sum(f"h_{m}").over(w_l).alias(f"r_{m}")
                                              for m in ("prec", "rec", "f1", "has")])
    w_t = Window.partitionBy(*by, "lim").orderBy(F.desc("ti")).rowsBetween(Window.unboundedPreceding, 0)
    step2 = step1.select(*by, "ti", "lim", *[F.sum(f"r_{m}").over(w_t).alias(f"c_{m}")
                                              for m in ("prec", "rec", "f1", "has")])
    thr = F.lit(0.0) if ordinal else F.col("ti").cast("double") / F.lit(float(steps))
    return step2.select(*by, thr.alias("threshold"), F.col("lim").alias("limit"),
                        safe_ratio(F.col("c_prec"), F.col("c_has")).alias("precision"),
                        safe_ratio(F.col("c_rec"), n_docs).alias("recall"),
                        safe_ratio(F.col("c_f1"), n_docs).alias("f1"))


def pr_curve(grid: DataFrame, by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """One point per distinct recall: the best precision at that recall or
    beyond (``prec_cummax``). Recall and precision are rounded to ``digits``
    so that equal recalls reached by different cells are one point."""
    pts = grid.where(F.col("precision").isNotNull()).select(
        *by, stable_round(F.col("recall"), digits).alias("recall"),
        stable_round(F.col("precision"), digits).alias("precision"))
    pts = pts.groupBy(*by, "recall").agg(F.max("precision").alias("precision"))
    w = Window.partitionBy(*by).orderBy(F.desc("recall")).rowsBetween(Window.unboundedPreceding, 0)
    return pts.select(*by, "recall", F.max("precision").over(w).alias("precision"))


def pr_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve, step rule from recall 0."""
    w = Window.partitionBy(*by).orderBy("recall")
    area = (F.col("recall") - F.lag("recall", 1, 0.0).over(w)) * F.col("precision")
    return curve.select(*by, area.alias("_a")).groupBy(*by).agg(F.sum("_a").alias("pr_auc"))


def opt_cutoff(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best-F1 cell. Ties: the higher threshold, then the smaller limit."""
    w = Window.partitionBy(*by).orderBy(F.desc(stable_round(F.col("f1"), 12)), F.desc("threshold"), F.asc("limit"))
    return grid.where(F.col("f1").isNotNull()) \
        .withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_cutoff(pred_ranked: DataFrame, cutoff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cut every key's predictions at its own best cell (one cut-off row per key)."""
    if not by:
        t, lim = cutoff.select("threshold").scalar(), cutoff.select("limit").scalar()
        return pred_ranked.where((F.col("rank") <= lim) & (F.col("score") >= t))
    c = cutoff.select(*by, F.col("threshold").alias("_t"), F.col("limit").alias("_l"))
    joined = pred_ranked.join(F.broadcast(c), list(by), "inner")
    return joined.where((F.col("rank") <= F.col("_l")) & (F.col("score") >= F.col("_t"))).drop("_t", "_l")


def evaluate(gold: DataFrame, pred: DataFrame, by: Sequence[str] = (), steps: int = 100,
             ordinal: bool = False, set_only: bool = False) -> dict[str, DataFrame]:
    """The evaluate stage: grid, curve, area, cut at the best cell, strata."""
    if set_only:
        return {"metrics": strata_scores(gold, pred, by)}
    # scores are compared at 1e-9: summation noise must not split a tie
    pred = pred.withColumn("score", stable_round(F.col("score"), 9))
    grid = pr_grid(gold, pred, by, steps, ordinal)
    curve = pr_curve(grid, by)
    best = opt_cutoff(grid, by)
    cut_pred = apply_cutoff(rank_predictions(pred, by), best, by)
    return {"grid": grid, "curve": curve, "auc": pr_auc(curve, by), "cutoff": best,
            "metrics": strata_scores(gold, cut_pred, by)}


# ------------------------------------------------------------ reporting

def f1_at_k(gold: DataFrame, pred: DataFrame, k: int = 5, by: Sequence[str] = (),
            mode: str = "micro") -> DataFrame:
    """E10 (and E12's stand-in at k): P10 ``rank <= k`` then set scores (E6
    micro by default); returns (by..., metric, value) overall."""
    top = cut(rank_predictions(pred, by), limit=k)
    return set_scores(gold, top, by=by, mode=mode).select(*by, "metric", "value")


def overall(metrics: DataFrame, metric: str | None = "f1") -> DataFrame:
    """The overall rows (language = text_type = 'all'), optionally one metric."""
    m = metrics.where((F.col("language") == "all") & (F.col("text_type") == "all"))
    return m.where(F.col("metric") == metric) if metric else m


def pivot_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metric rows -> one column per metric (the metric list is fixed)."""
    return metrics.groupBy(*by, *STRATA).pivot("metric", list(METRICS)).agg(F.first("value"))


def compare_ensembles(metrics: DataFrame, key: str = "ensemble") -> DataFrame:
    """J13 + U2: metric tables of several ensembles side by side, one
    column per ensemble (a pivot instead of a chain of inner joins)."""
    return overall(metrics, None).groupBy("metric").pivot(key).agg(F.first("value"))


def top_n(df: DataFrame, col: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """``arrange(desc(col)) |> head(n)`` as TakeOrdered."""
    order = [F.desc(col)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)
