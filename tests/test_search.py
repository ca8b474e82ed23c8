"""Search, ensemble and search-loop properties (t4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjex.operators import knn
from subjex.operators.bm25 import bm25, hybrid

SF = "/root/testdata/sf0.001"


def _vec(spark):
    from subjex.plans import fixtures as X
    return X.vec_queries(spark, SF), X.vec_vocab(spark, SF)


def test_block_count_invariance(spark):
    q, v = _vec(spark)
    a = {tuple(r) for r in knn.nearest(q, v, k=3).select("query_id", "label_id").collect()}
    b = {tuple(r) for r in knn.nearest(q, v, k=3, query_block_bytes=1500, vocab_block_bytes=9000)
         .select("query_id", "label_id").collect()}
    assert a == b and len(a) == 3 * q.count()


def test_knn_matches_numpy(spark):
    q, v = _vec(spark)
    qs = q.orderBy("query_id").collect()
    vs = v.orderBy("label_id").collect()
    Q = np.array([r.embedding for r in qs], dtype=float)
    Vm = np.array([r.embedding for r in vs], dtype=float)
    sims = (Q / np.linalg.norm(Q, axis=1, keepdims=True)) @ (Vm / np.linalg.norm(Vm, axis=1, keepdims=True)).T
    want = {qs[i].query_id: vs[int(np.argmax(sims[i]))].label_id for i in range(len(qs))}
    got = dict(knn.nearest(q, v, k=1).select("query_id", "label_id").collect())
    assert got == want


def test_ivf_full_probe_equals_exact(spark):
    q, v = _vec(spark)
    exact = dict(knn.nearest(q, v, k=1).select("query_id", "label_id").collect())
    approx = dict(knn.nearest_clusters(q, v, k=1, n_clusters=4, n_probe=4).select("query_id", "label_id").collect())
    assert approx == exact


def test_bm25_prefers_rare_shared_token(spark):
    corpus = spark.createDataFrame([("a", "the cat sat"), ("b", "the dog sat"), ("c", "the the the")],
                                   "label_id string, label_text string")
    qs = spark.createDataFrame([(1, "cat the"), (2, "dog"), (3, "zebra")], "query_id long, query string")
    got = dict(bm25(qs, corpus, k=1).select("query_id", "label_id").collect())
    assert got == {1: "a", 2: "b"}


def test_hybrid_alpha_one_is_vector_search(spark):
    q, v = _vec(spark)
    qq = q.withColumn("query", F.lit("x"))
    vv = v.withColumn("label_text", F.concat(F.lit("x "), F.col("label_id")))
    h = dict(hybrid(qq, vv, alpha=1.0, depth=5).select("query_id", "label_id").collect())
    e = dict(knn.nearest(q, v, k=1).select("query_id", "label_id").collect())
    assert h == e


def _pred(spark):
    from subjex.plans import fixtures as X
    return X.pred(spark, SF), X.gold(spark, SF)


def test_ensemble_of_one_member_is_that_member(spark):
    from subjex.operators import ensemble as E
    p, _ = _pred(spark)
    mem = spark.createDataFrame([("solo", "A", "F", 1)], "ensemble string, model string, prompt string, ord int")
    v = E.vote(p, mem).select("doc_id", "label_id", "score")
    from subjex.operators.mapping import best_match
    b = best_match(p.where("model = 'A' AND prompt = 'F'")).select(
        "doc_id", "label_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine_similarity")).alias("score"))
    assert sorted(v.collect()) == sorted(b.collect())


def test_vote_score_bounded(spark):
    from subjex.operators import ensemble as E
    from subjex.plans import fixtures as X
    v = E.vote(X.pred(spark, SF), X.members(spark, SF))
    r = v.agg(F.max("score").alias("s"), F.max("count").alias("c")).first()
    assert r.s <= 1.0 and r.c <= 6


def test_greedy_forward_first_pick_is_best_single(spark):
    from subjex.operators.search import candidate_auc, greedy_forward, member_scores
    p, g = _pred(spark)
    p = p.select("model", "prompt", "doc_id", "label_id", "score")
    chain = greedy_forward(p, g, rounds=2).collect()
    singles = candidate_auc(g, member_scores(p).withColumnRenamed("member", "candidate"))
    best = singles.orderBy(F.desc("pr_auc"), "candidate").first()
    assert chain[0].model_prompt == best.candidate
    assert chain[0].cum_score == pytest.approx(best.pr_auc)
    assert len({c.model_prompt for c in chain}) == 2


def test_greedy_backward_removal_matches_direct_mean(spark):
    from subjex.operators.search import candidate_auc, greedy_backward, member_scores
    p, g = _pred(spark)
    p = p.select("model", "prompt", "doc_id", "label_id", "score")
    _, chain = greedy_backward(p, g, rounds=1)
    first = chain.first()
    ms = member_scores(p)
    rest = ms.where(F.col("member") != first.model_prompt)
    n = rest.select("member").distinct().count()
    direct = rest.groupBy("doc_id", "label_id").agg((F.sum("score") / n).alias("score")) \
        .withColumn("candidate", F.lit("x"))
    assert candidate_auc(g, direct).first().pr_auc == pytest.approx(first.score, abs=1e-9)


def test_sample_ensembles_sizes(spark):
    from subjex.operators import ensemble as E
    from subjex.operators.search import sample_ensembles
    p, _ = _pred(spark)
    ex = E.existing_members(p, big_models=["R"])
    m = sample_ensembles(ex, n=3, max_big=1, samples=5, seed=2)
    sizes = {r.ensemble: r.n for r in m.groupBy("ensemble").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes and all(n == 3 for n in sizes.values())
    big = m.where("model = 'R'").groupBy("ensemble").count().collect()
    assert all(r["count"] <= 1 for r in big)


@pytest.mark.parametrize("parts", [3, 8, 13])
def test_blocked_search_independent_of_shuffle_partitions(spark, parts):
    """Block ids must hash alike on both cogroup sides (same type), whatever
    the partition count."""
    from subjex.plans import fixtures as X
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        q, v = _vec(spark)
        got = knn.nearest(q, v, k=2, query_block_bytes=3000, vocab_block_bytes=9000).count()
        assert got == 2 * q.count()
        tq = X.text_queries(spark, SF)
        n = bm25(tq, X.text_corpus(spark, SF), k=1, label_block_bytes=200_000).count()
        assert n == tq.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
