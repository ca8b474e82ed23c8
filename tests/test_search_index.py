"""Keyword ranges, hybrid threshold search, the persisted vector index and ensembles as weights: against exhaustive versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjex.operators import bm25 as B
from subjex.operators import evaluate as V
from subjex.operators import knn
from subjex.operators import matrix as X
from subjex.operators import search as S
from subjex.operators.vector_index import build_index, open_index, partials, search
from subjex.session import cut_lineage

SF = "/root/testdata/sf0.01"


def _texts(n, seed, words=400, longest=12):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices([f"w{i}" for i in range(words)], weights, k=rng.randint(1, longest))) for _ in range(n)]


def _bm25_by_hand(queries, corpus):
    """{query: {(label, text): score}} over every label row."""
    split = lambda t: [x for x in re.split(r"[^\w]+", t.lower()) if x]
    docs = [(key, split(key[1])) for key in corpus]
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in queries:
        got = {}
        for key, t in docs:
            s = sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (.25 + .75 * len(t) / avg)) for w in set(split(text)) & set(t))
            if s > 0:
                got[key] = s
        out[q] = got
    return out


def test_keyword_search_equals_all_scores_and_skips_ranges(spark):
    corpus = sorted({(f"l{i % 900}", t) for i, t in enumerate(_texts(1200, 1))})
    queries = list(enumerate(_texts(40, 2, longest=5)))
    want = _bm25_by_hand(queries, corpus)
    q = spark.createDataFrame(queries, "query_id long, query string")
    c = spark.createDataFrame(corpus, "label_id string, label_text string")
    index = B.bm25_index(c, width=8)
    named = {r.row: r.label_text for r in c.select(F.md5("label_text").alias("row"), "label_text").collect()}
    for k, blocks in ((1, 64 << 20), (7, 300)):  # one query block, and several
        got = {}
        for r in B.bm25(q, k=k, index=index, query_block_bytes=blocks).collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.label_id, r.row, named[r.row]))
        for i, scores in want.items():
            top = sorted((-round(s, 9), label, _md5(t)) for (label, t), s in scores.items())[:k]
            assert [x[:3] for x in sorted(got.get(i, []))] == top
    qtok = cut_lineage(B.query_tokens(q))
    _, first, rest = B._search(index, qtok, 1, 64 << 20, 256 << 20)
    read = B.postings_of(index, first.unionByName(rest), qtok)
    every = B.postings_of(index, B.range_bounds(index, qtok).select("query_id", "range"), qtok)
    assert 0 < read < every
    pairs = sum(first.unionByName(rest).join(qtok, "query_id").join(index.blocks, ["range", "tok"]).agg(F.sum("n")).first())
    all_pairs = qtok.join(index.blocks, "tok").agg(F.sum("n")).first()[0]
    assert pairs < 0.6 * all_pairs  # postings scored


def _md5(t):
    import hashlib
    return hashlib.md5(t.encode()).hexdigest()


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.7, 1.0])
def test_hybrid_equals_full_fusion(spark, alpha):
    rng = np.random.default_rng(5)
    corpus = sorted({(f"l{i % 250}", t) for i, t in enumerate(_texts(300, 3, words=80))})
    vectors = rng.normal(size=(len(corpus), 6))
    vectors[10] = vectors[11]
    queries = [*enumerate(_texts(11, 4, words=80, longest=4)), (99, "unknown words")]
    qv = rng.normal(size=(len(queries), 6))
    scores = _bm25_by_hand(queries, corpus)
    cos = (qv / np.linalg.norm(qv, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    want = {}
    for n, (i, _) in enumerate(queries):
        most = max(scores[i].values(), default=0)
        fused = [alpha * (cos[n, j] - cos[n].min()) / (cos[n].max() - cos[n].min()) + (1 - alpha) * (scores[i].get(key, 0) / most if most else 0) for j, key in enumerate(corpus)]
        best = min(range(len(corpus)), key=lambda j: (-round(fused[j], 9), corpus[j][0], _md5(corpus[j][1])))
        want[i] = (*corpus[best], round(fused[best], 9), round(cos[n, best], 9))
    q = spark.createDataFrame([(i, t, qv[n].tolist()) for n, (i, t) in enumerate(queries)], "query_id long, query string, embedding array<double>")
    v = spark.createDataFrame([(*key, vectors[j].tolist()) for j, key in enumerate(corpus)], "label_id string, label_text string, embedding array<double>")
    got = {r.query_id: (r.label_id, r.term, round(r.hybrid_score, 9), round(r.cosine, 9)) for r in B.hybrid(q, v, alpha, depth=4).collect()}
    assert got == want


def _vectors(spark):
    from subjex.plans import fixtures as FX
    return cut_lineage(FX.vec_queries(spark, SF)), cut_lineage(FX.vec_vocab(spark, SF))


def _pairs(df):
    return {(r.query_id, r.label_id, r.label_text, round(r.cosine, 9)) for r in df.collect()}


def test_index_is_exact_where_asked_and_saves_products(spark):
    q, v = _vectors(spark)
    exact = {k: _pairs(knn.nearest(q, v, k=k)) for k in (1, 5)}
    index = open_index(spark, build_index(v, n_clusters=12, queries=q).path)
    assert int(index.sizes.sum()) == v.count() and index.words.shape == (32, 256, 2)
    for k in (1, 5):
        assert _pairs(search(index, q, k, n_probe=2, exact=True)) == exact[k]
        assert _pairs(search(index, q, k, n_probe=2, exact=True, query_bytes=0)) == exact[k]  # both sides meet by cluster
    for bytes_ in (0, 64 << 20):
        used = partials(index, q, 1, n_probe=2, exact=True, query_bytes=bytes_).agg(F.sum("dots")).first()[0]
        assert q.count() <= used < 0.5 * q.count() * v.count()
    found = _pairs(search(index, q, 1))
    assert len(found & exact[1]) >= 0.95 * len(exact[1])


def test_cluster_search_reaches_its_recall(spark):
    from subjex.plans.queries import q_knn_ivf
    q, v = _vectors(spark)
    ids = lambda df: {(r.query_id, r.label_id) for r in df.select("query_id", "label_id").collect()}
    exact = ids(knn.nearest(q, v, k=1))
    got = {"query": ids(q_knn_ivf(spark, SF)), "root": ids(knn.nearest_clusters(q, v, n_clusters=round(v.count() ** 0.5)))}
    assert min(len(exact & found) / len(exact) for found in got.values()) >= 0.95


def test_index_of_few_and_odd_vectors(spark):
    rows = [(f"l{i}", f"t{i}", [float(i == 0), 1.0, 0.0]) for i in range(5)] + [("l9", "t", [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "label_id string, label_text string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    index = build_index(v, n_clusters=8)
    for bytes_ in (0, 64 << 20):
        assert _pairs(search(index, q, 2, exact=True, query_bytes=bytes_)) == _pairs(knn.nearest(q, v, k=2))
    none = build_index(v.limit(0))
    assert search(none, q).count() == 0 and search(index, q.limit(0)).count() == 0


def _random_predictions(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for m in range(6):
        for d in range(40):
            if rng.random() < 0.5:
                for label in rng.sample(range(30), rng.randint(1, 8)):
                    rows.append((f"M{m % 3}", f"p{m}", d, f"g{label}", round(rng.random(), 2)))
    gold = [(d, f"g{x}") for d in range(3, 45) for x in rng.sample(range(30), rng.randint(1, 5))]
    pred = spark.createDataFrame(rows, "model string, prompt string, doc_id long, label_id string, score double").withColumn("cosine_similarity", F.col("score"))
    return pred, spark.createDataFrame(gold, "doc_id long, label_id string")


def _area(gold, sets):
    return V.pr_auc(V.pr_curve(V.pr_grid(gold, sets, by=["candidate"]), by=["candidate"]), by=["candidate"])


def test_weighted_ensembles_equal_the_grid(spark):
    pred, gold = _random_predictions(spark)
    members = S.member_scores(pred)
    sets = members.groupBy("doc_id", "label_id").agg((F.sum("score") / 6).alias("score")).withColumn("candidate", F.lit("all"))
    want = {"all": _area(gold, sets).first().pr_auc}
    for r in _area(gold, members.withColumnRenamed("member", "candidate")).collect():
        want[r.candidate] = r.pr_auc
    for most in (X.MOST, 6):  # every document as a row, and large ones long
        m = X.member_matrix(members, gold, most)
        assert (m.large is None) == (most == X.MOST)
        e = X.Ensembles(["all", *m.members], np.vstack([np.ones(6), np.eye(6)]), np.array([6.0] + [1.0] * 6))
        got = {r.candidate: r.pr_auc for r in X.areas(m, e).collect()}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_differences_to_the_base_equal_whole_sets(spark):
    pred, gold = _random_predictions(spark)
    m = X.member_matrix(S.member_scores(pred), gold)
    base = np.array([1.0, 0, 2, 0, 0, 0])
    for change, clip, own in ((1.0, False, [1, 3, 4, 5]), (-1.0, True, [0, 2])):
        w = np.repeat(base[None], len(own), axis=0)
        w[np.arange(len(own)), own] += change
        names = [m.members[i] for i in own]
        apart = X.Ensembles(names, w, np.full(len(own), 4.0), clip, base, own)
        whole = X.Ensembles(names, w, np.full(len(own), 4.0), clip)
        a, b = ({r.candidate: r.pr_auc for r in X.areas(m, e).collect()} for e in (apart, whole))
        assert a.keys() == b.keys() and all(abs(a[c] - b[c]) < 1e-9 for c in a)
    # a candidate is scored on the documents of its own member only
    batch = m.rows.toArrow().combine_chunks().to_batches()[0]
    docs = X._Batch(batch, 6)
    w = base.copy()
    w[1] += 1
    scored, _ = docs.scores(w, 4.0, False, docs.docs_of[1])
    assert set(docs.doc[scored]) == set(np.flatnonzero(docs.docs_of[1])) and len(scored) < len(docs.scores(w, 4.0, False)[0])


def test_recurrent_search_equals_fused_lists(spark):
    """Every remaining table is fused with the pick's table with weight n, as written in the definition."""
    pred, gold = _random_predictions(spark, 8)
    got = [(r.model_prompt, r.cum_score) for r in S.greedy_forward(pred, gold, rounds=4, weights="recurrent").collect()]
    tables = {}
    for r in S.member_scores(pred).collect():
        tables.setdefault(r.member, {})[r.doc_id, r.label_id] = r.score
    for n, (name, value) in enumerate(got, 1):
        rows = [(c, d, x, s) for c, t in tables.items() for (d, x), s in t.items()]
        areas = {r.candidate: r.pr_auc for r in _area(gold, spark.createDataFrame(rows, "candidate string, doc_id long, label_id string, score double")).collect()}
        assert name == min(areas, key=lambda c: (-round(areas[c], 9), c)) and abs(value - areas[name]) < 1e-9
        pick = tables.pop(name)
        for t in tables.values():
            for key in set(t) | set(pick):
                t[key] = (t.get(key, 0.0) + n * pick.get(key, 0.0)) / (n + 1)
