"""Driver contract: smoke entry, every query runs at sf0.001, oracles agree."""


import duckdb
import pytest

import __spark_entry__ as ent

from .conftest import SMOKE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"ensemble", "metric", "value", "language", "text_type", "pr_auc"} <= set(df.columns)


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


FAST = ["q_best_match", "q_ensemble_vote", "q_combine", "q_set_scores", "q_strata_scores", "q_pr_grid",
        "q_pr_auc", "q_opt_cutoff", "q_gold_explode", "q_parse_answers", "q_knn_top1", "q_bm25_top1",
        "q_records", "q_submission", "q_relevance_norm", "q_vocab_labels"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = ent.queries()[name](spark, SMOKE)
    got = sorted(repr([_norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    res = duck.execute(ent.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(repr([_norm(r[i]) for i in order]) for r in res.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())
