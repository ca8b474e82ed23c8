"""Third review: declarations of any number, whole sets of runs, memory of a task and of a batch."""

import os
import tempfile

import duckdb
import numpy as np
import pytest

import __spark_entry__ as ent

SKOS = "http://www.w3.org/2004/02/skos/core#"


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _against_sql(spark, name, sf, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    want = con.execute(ent.oracle_sql()[name])
    cols = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in cols]
    df = ent.queries()[name](spark, sf)
    assert sorted(df.columns) == cols
    got = sorted(map(repr, df.select(cols).toPandas().itertuples(index=False, name=None)))
    return got, sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def _runs(spark):
    """Line items of four orders by two runs; the first order has none of the run (A, F)."""
    sf = tempfile.mkdtemp(prefix="subjex-sf-")
    lines = [(1, 5, 1, "R", "O"), (2, 5, 1, "A", "F"), (2, 6, 1, "R", "O"), (3, 7, 2, "N", "O"), (4, 8, 2, None, "O")]
    spark.createDataFrame([(o, p, s, 10.0, 0.05, 0.0, f, st) for o, p, s, f, st in lines],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(i, "O", "1-URGENT") for i in range(1, 5)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    return sf


def test_unpredicted_docs_of_every_ensemble(spark):
    got, want = _against_sql(spark, "q_unpredicted_docs", _runs(spark), ["lineitem", "orders"])
    assert got == want
    assert {r for r in got if "'one-model-all-prompts'" in r} == {f"({i}, 'one-model-all-prompts')" for i in (3, 4)}
    assert {r for r in got if "'one-prompt-one-model'" in r} == {f"({i}, 'one-prompt-one-model')" for i in (1, 3, 4)}
    assert not any("'all'" in r for r in got)  # some run predicts every document


def test_turtle_with_a_declaration_before_every_statement(spark, small_splits):
    from subjex.sources.turtle import scan_turtle
    path = os.path.join(tempfile.mkdtemp(prefix="subjex-ttl-"), "v.ttl")
    n = 100_001
    with open(path, "w") as f:
        for i in range(n):
            f.write(f"@prefix s: <{SKOS}> .\n" + (f'<https://e.org/{i}> s:prefLabel "x{i}" .\n' if i % 1000 == 0 else ""))
    small_splits(1 << 19)
    rows = scan_turtle(spark, path).collect()
    assert sorted(tuple(r) for r in rows) == sorted((f"https://e.org/{i}", SKOS + "prefLabel", f"x{i}", True) for i in range(0, n, 1000))


@pytest.mark.parametrize("size", [1 << 27, 60, 9])
def test_turtle_declarations_take_effect_in_order(spark, small_splits, size):
    from subjex.sources.turtle import scan_turtle
    path = os.path.join(tempfile.mkdtemp(prefix="subjex-ttl-"), "v.ttl")
    with open(path, "w") as f:
        f.write("@base <http://a.org/x/> .\n@prefix s: <http://s.org/core#> . @prefix r: <rel/> .\n<1> s:p r:1 .\n"
                "@base <y/> .\n<2> s:p r:2 . @prefix r: <z/> .\n\n<3> s:p r:3 .\nBASE <http://b.org/>\n<4> s:p r:4 .\n@prefix s: <t#> .\n<5> s:p <6> .\n")
    small_splits(size)
    a = "http://a.org/x/"
    assert sorted((r.s, r.p, r.o) for r in scan_turtle(spark, path).collect()) == sorted([
        (a + "1", "http://s.org/core#p", a + "rel/1"), (a + "y/2", "http://s.org/core#p", a + "rel/2"), (a + "y/3", "http://s.org/core#p", a + "y/z/3"),
        ("http://b.org/4", "http://s.org/core#p", a + "y/z/4"), ("http://b.org/5", "http://b.org/t#p", "http://b.org/6")])


def _brute(q, v, labels, k):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(np.einsum("qd,vd->qv", unit(q), unit(v)), 12)
    return {(i, j, s[i, j]) for i in range(len(q)) for j in sorted(range(len(v)), key=lambda j: (-s[i, j], labels[j]))[:k]}


@pytest.mark.parametrize("k", [1, 5, 70, 400])
def test_candidates_by_group_are_the_k_best(k):
    from subjex.operators.knn import _topk_rows
    rng = np.random.default_rng(k)
    q, v = rng.normal(size=(9, 7)), rng.normal(size=(333, 7))
    v[50:90], v[200] = v[3], 0.0  # ties and a vector without a direction
    q[4] = v[3]
    labels = [f"l{(i * 38) % 333:03d}" for i in range(333)]
    place = np.argsort(np.argsort(labels))
    got = [x for x in _topk_rows(q, v, place, k)]
    rows = {(int(i), int(j), float(s)) for qi, li, sc in got for i, j, s in zip(qi, li, sc)}
    assert {r[:2] for r in rows} == {r[:2] for r in _brute(q, v, labels, k)} and len(rows) == 9 * min(k, 333)


def test_product_of_blocks_stays_small():
    """64 queries by 120,000 labels: the whole product would take 61 MB in double precision."""
    import tracemalloc
    from subjex.operators.knn import _topk_rows
    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(64, 4)), rng.normal(size=(120_000, 4))
    tracemalloc.start()
    n = sum(len(qi) for qi, _, _ in _topk_rows(q, v, np.arange(len(v)), 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64 and peak < 48e6


def test_hybrid_writes_no_lists_that_grow_with_pairs(spark):
    """Keywords and vectors that disagree: no query is decided by the tops of its lists."""
    from subjex.operators.bm25 import hybrid
    from subjex.session import ensure_checkpoint_dir
    rng = np.random.default_rng(2)
    n = 600
    v = spark.createDataFrame([(str(i), " ".join(f"w{(i * 7 + j) % 50}" for j in range(1 + i % 40)), rng.normal(size=4).tolist()) for i in range(n)], "label_id string, label_text string, embedding array<double>")
    q = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 20)), rng.normal(size=4).tolist()) for i in range(30)], "query_id long, query string, embedding array<double>")
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    old = set(os.listdir(root))
    assert hybrid(q, v, 0.5, block_bytes=4096).count() == 30
    written = [spark.read.parquet(f"{root}/{d}").count() for d in set(os.listdir(root)) - old]
    assert max(written) < n * 41  # postings; the pairs are 18,000 and each of the old lists reached them


def test_embed_returns_a_model_batch_at_a_time(spark):
    from subjex.operators.infer import embed

    def encode(texts):
        assert len(texts) <= 3
        return np.array([[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i) for i in range(20)], "i long, t string").coalesce(1)
    rows = {r.i: list(r.embedding) for r in embed(df, "t", encode, batch=3).collect()}
    assert rows == {i: pytest.approx(list(np.array([0 if i % 5 == 0 else i, 1.0]) / np.hypot(0 if i % 5 == 0 else i, 1.0)), abs=1e-6) for i in range(20)}


def test_shuffles_grow_with_the_line_items(spark, monkeypatch):
    from subjex import session
    from subjex.plans import fixtures as X
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.size_shuffles(spark, 10)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        monkeypatch.setattr(session.size_shuffles, "__defaults__", (1,))
        for build in (X.pred, X.gold, X.rank_input, X.dataset):
            spark.conf.set("spark.sql.shuffle.partitions", "2")
            build(spark, _runs(spark))
            assert spark.conf.get("spark.sql.shuffle.partitions") == "5"  # a task per line item
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
