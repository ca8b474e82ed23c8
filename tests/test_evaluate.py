"""Properties of the evaluation operators (t4)."""

import random

import pytest
from pyspark.sql import functions as F

from subjex.operators import evaluate as V


def brute_grid(gold, pred, steps):
    """Every cell re-evaluated from scratch in Python."""
    gsets = {}
    for d, l in gold:
        gsets.setdefault(d, set()).add(l)
    by_doc = {}
    for d, l, s in pred:
        by_doc.setdefault(d, []).append((l, s))
    maxp = max(len(v) for v in by_doc.values())
    out = {}
    for i in range(steps + 1):
        t = i / steps
        for lim in range(1, maxp + 1):
            sp = sr = sf = 0.0
            nh = 0
            for d, g in gsets.items():
                ps = by_doc.get(d, [])
                ret = [l for l, s in ps if s >= t and 1 + sum(1 for _, s2 in ps if s2 > s) <= lim]
                tp = sum(1 for l in ret if l in g)
                if ret:
                    sp += tp / len(ret)
                    nh += 1
                sr += tp / len(g)
                sf += 2 * tp / (len(ret) + len(g))
            n = len(gsets)
            out[(t, lim)] = (sp / nh if nh else None, sr / n, sf / n)
    return out


def test_pr_grid_matches_brute_force(spark):
    rnd = random.Random(3)
    gold, pred = [], []
    for d in range(40):
        labels = [f"l{j}" for j in range(8)]
        for l in rnd.sample(labels, rnd.randint(1, 4)):
            gold.append((f"d{d}", l))
        if d % 7 == 3:
            continue  # a gold document without predictions
        for l in rnd.sample(labels, rnd.randint(1, 6)):
            pred.append((f"d{d}", l, rnd.choice([0.1, 0.3, 0.3, 0.5, 0.55, 0.9, 1.0])))
    pred.append(("unjudged", "l1", 0.7))
    steps = 10
    g = spark.createDataFrame(gold, "doc_id string, label_id string")
    p = spark.createDataFrame(pred, "doc_id string, label_id string, score double")
    got = {(r.threshold, r.limit): (r.precision, r.recall, r.f1) for r in V.pr_grid(g, p, steps=steps).collect()}
    want = brute_grid(gold, pred, steps)
    assert set(got) == set(want)
    for k, (wp, wr, wf) in want.items():
        gp, gr, gf = got[k]
        assert (gp is None) == (wp is None), k
        if wp is not None:
            assert gp == pytest.approx(wp, abs=1e-9), k
        assert gr == pytest.approx(wr, abs=1e-9) and gf == pytest.approx(wf, abs=1e-9), k


def test_rprec_at_least_precision_and_recall_per_doc(spark):
    gold = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "doc_id string, label_id string")
    pred = spark.createDataFrame([("d", "a"), ("d", "c"), ("d", "e"), ("e", "a"), ("e", "b")],
                                 "doc_id string, label_id string")
    c = V._doc_measures(V.doc_counts(V.with_strata(gold), pred)).collect()
    for r in c:
        assert r._rprec >= max(r._prec, r._rec) - 1e-12


def test_strata_rows_and_all_label(spark):
    gold = spark.createDataFrame([("d", "a", "de", "Book"), ("e", "a", "en", "Book")],
                                 "doc_id string, label_id string, language string, text_type string")
    pred = spark.createDataFrame([("d", "a")], "doc_id string, label_id string")
    rows = V.strata_scores(gold, pred).collect()
    strata = {(r.language, r.text_type) for r in rows}
    assert strata == {("all", "all"), ("de", "all"), ("en", "all"), ("all", "Book"), ("de", "Book"), ("en", "Book")}
    rec = {(r.language, r.text_type): r.value for r in rows if r.metric == "rec"}
    assert rec[("all", "all")] == 0.5 and rec[("de", "Book")] == 1.0 and rec[("en", "all")] == 0.0


def test_micro_mode(spark):
    gold = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "c")], "doc_id string, label_id string")
    pred = spark.createDataFrame([("d", "a"), ("d", "x"), ("e", "c"), ("e", "y")], "doc_id string, label_id string")
    got = {r.metric: r.value for r in V.set_scores(gold, pred, mode="micro").collect()}
    assert got["prec"] == 0.5 and got["rec"] == pytest.approx(2 / 3)


def test_gold_parse_first_match_per_piece(spark):
    df = spark.createDataFrame([("d", "['gnd:1', 'gnd:2-3X' 'gnd:9', 'junk']", "de", "Book")],
                               "doc_id string, `dcterms:subject` string, language string, text_type string")
    got = sorted(r.label_id for r in V.gold_from_dataset(df).collect())
    assert got == ["gnd:1", "gnd:2-3X"]
    assert V.count_unparsed_pieces(df).first().n_unparsed == 1


def test_auc_and_cutoff_are_consistent(spark):
    gold = spark.createDataFrame([("d", "a"), ("e", "b")], "doc_id string, label_id string")
    pred = spark.createDataFrame([("d", "a", 0.9), ("d", "z", 0.2), ("e", "b", 0.6)],
                                 "doc_id string, label_id string, score double")
    res = V.evaluate(gold, pred, steps=10)
    best = res["cutoff"].first()
    assert best.f1 == 1.0 and best.threshold > 0.2
    assert res["auc"].first().pr_auc == pytest.approx(1.0)
    m = {r.metric: r.value for r in res["metrics"].where("language = 'all' AND text_type = 'all'").collect()}
    assert m["f1"] == 1.0


def test_reporting_helpers(spark):
    gold = spark.createDataFrame([("d", "a", "de", "Book"), ("e", "b", "en", "Book")],
                                 "doc_id string, label_id string, language string, text_type string")
    pred = spark.createDataFrame([("x", "d", "a", 0.9), ("x", "d", "z", 0.1), ("y", "e", "b", 0.5)],
                                 "ensemble string, doc_id string, label_id string, score double")
    f = {(r.ensemble, r.metric): r.value for r in V.f1_at_k(gold, pred, k=1, by=["ensemble"]).collect()}
    assert f[("x", "prec")] == 1.0 and f[("y", "rec")] == 0.5
    m = V.strata_scores(gold, pred, by=["ensemble"])
    wide = V.compare_ensembles(m).where("metric = 'rec'").first()
    assert wide.x == 0.5 and wide.y == 0.5
    piv = V.pivot_metrics(V.overall(m, None), by=["ensemble"]).where("ensemble = 'x'").first()
    assert piv.prec == 0.5 and piv.rprec == 1.0  # d: 1 of 2 predicted labels right
    top = V.top_n(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "k string, v double"), "v", 2, "k")
    assert [r.k for r in top.collect()] == ["b", "c"]


def test_member_from_path_and_match_stats(spark):
    from subjex.operators.mapping import match_stats
    from subjex.sources.tables import member_from_path
    df = spark.createDataFrame([("/r/results/llama/p-1/predictions.csv",)], "file_path string")
    assert df.select(member_from_path().alias("m")).first().m == "llama_p-1"
    best = spark.createDataFrame([(1.0, None), (0.8, 0.5)], "cosine_similarity double, hybrid_score double")
    r = match_stats(best).first()
    assert (r.n_perfect_matches, r.n_only_vector_matches) == (1, 1)


def test_doc_prefix_matches_brute_force(spark):
    """Sums over strictly higher scores per document, through score buckets:
    a hot document spread over many buckets, repeated scores, out-of-range
    scores in the edge buckets."""
    rnd = random.Random(11)
    rows = [("hot", round(rnd.uniform(-0.2, 1.2), 4), rnd.randint(1, 3)) for _ in range(400)]
    rows += [("cold", s, 1) for s in (0.5, 0.25, 0.25 + 1e-7)]
    agg = {}
    for d, sc, n in rows:
        agg[(d, sc)] = agg.get((d, sc), 0) + n
    ties = spark.createDataFrame([(d, sc, n) for (d, sc), n in agg.items()], "doc_id string, score double, _n long")
    got = {(r.doc_id, r.score): r.above_n for r in V.doc_prefix(ties, ["doc_id"], ["_n"]).collect()}
    want = {(d, sc): sum(n for (d2, s2), n in agg.items() if d2 == d and s2 > sc) for (d, sc) in agg}
    assert got == want


def test_sparse_grid_gives_same_curve_and_cutoff(spark):
    rnd = random.Random(5)
    gold, pred = [], []
    for d in range(30):
        for j in range(rnd.randint(1, 3)):
            gold.append((f"d{d}", f"l{j}"))
        for j in range(rnd.randint(1, 7)):
            pred.append((f"d{d}", f"l{j}", rnd.choice([0.2, 0.4, 0.4, 0.8, 0.95])))
    g = spark.createDataFrame(gold, "doc_id string, label_id string")
    p = spark.createDataFrame(pred, "doc_id string, label_id string, score double")
    dense, sparse = V.pr_grid(g, p, steps=20), V.pr_grid(g, p, steps=20, dense=False)
    assert sparse.count() < dense.count()
    assert sorted(V.pr_curve(dense).collect()) == sorted(V.pr_curve(sparse).collect())
    assert V.opt_cutoff(dense).collect() == V.opt_cutoff(sparse).collect()
