"""Hand-made tables, one per trap (FIXTURES.md section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from subjex.functions.scores import clip01
from subjex.functions.text import answer_keywords, relevance_value
from subjex.operators import combine as C
from subjex.operators import ensemble as E
from subjex.operators import evaluate as V
from subjex.operators import mapping as M
from subjex.operators import ranking as R

PRED_COLS = "model string, prompt string, doc_id string, label_id string, candidate string, term string, " \
            "cosine_similarity double, hybrid_score double"


def test_tie_in_best_match_takes_greatest_candidate(spark):
    df = spark.createDataFrame([("m", "p", "d", "l", "a", "ta", 0.8, 0.1),
                                ("m", "p", "d", "l", "b", "tb", 0.8, 0.2)], PRED_COLS)
    r = M.best_match(df, by=["model", "prompt"]).collect()[0]
    assert (r.candidate, r.term, r.hybrid_score) == ("b", "tb", 0.2)


def test_vote_with_absent_member(spark):
    mem = spark.createDataFrame([("e", "m1", "p", 1), ("e", "m2", "p", 2), ("e", "m3", "p", 3)],
                                "ensemble string, model string, prompt string, ord int")
    pred = spark.createDataFrame([("m1", "p", "d", "l", "c", "early", 0.9, 0.5),
                                  ("m3", "p", "d", "l", "c", "late", 0.6, 0.4)], PRED_COLS)
    r = E.vote(pred, mem).collect()[0]
    assert r.score == pytest.approx(0.5) and r["count"] == 2 and r.term == "late"
    assert r.cosine_similarity == 0.9 and r.hybrid_score == 0.5


def test_clip_nan_is_null_not_one(spark):
    df = spark.createDataFrame([(1.2,), (-0.1,), (float("nan"),)], "x double")
    got = [r.c for r in df.select(clip01(F.col("x")).alias("c")).collect()]
    assert got == [1.0, 0.0, None]


def test_answer_parsing(spark):
    df = spark.createDataFrame([("\nAa, Bb",), ("Aa, x,  Bb <eos>",), ("Aa, Aa",), (" Cc , Dd\n, Ee",)], "a string")
    got = [sorted(r.k) for r in df.select(answer_keywords(F.col("a")).alias("k")).collect()]
    assert got == [[], ["Aa", "Bb"], ["Aa"], ["Cc", "Dd"]]


def test_relevance_parsing(spark):
    df = spark.createDataFrame([("8",), ("8/10",), ("keine",), ("",), (None,), ("7.5",)], "a string")
    got = [r.v for r in df.select(relevance_value(F.col("a")).alias("v")).collect()]
    assert got == [8.0, 810.0, 0.0, 0.0, 0.0, 75.0]


def test_all_relevance_zero_gives_zero_without_error(spark):
    ans = spark.createDataFrame([("d", "t1", "0"), ("d", "t2", "nein")], "doc_id string, term string, answer string")
    pred = spark.createDataFrame([("d", "l1", "t1"), ("d", "l2", "t2")], "doc_id string, label_id string, term string")
    rows = R.normalise_relevance(R.accept(ans), pred).collect()
    assert sorted((r.label_id, r.score) for r in rows) == [("l1", 0.0), ("l2", 0.0)]


def test_cap_takes_alphabetical_not_most_relevant(spark):
    ans = spark.createDataFrame([("d", "c", "10"), ("d", "a", "1"), ("d", "b", "1")],
                                "doc_id string, term string, answer string")
    got = [r.term for r in R.accept(ans, threshold=0, max_suggestions=2).orderBy("term").collect()]
    assert got == ["a", "b"]


def test_shared_term_keeps_greatest_label(spark):
    ans = spark.createDataFrame([("d", "T", "5")], "doc_id string, term string, answer string")
    pred = spark.createDataFrame([("d", "gnd:1", "T"), ("d", "gnd:2", "T")], "doc_id string, label_id string, term string")
    rows = R.normalise_relevance(R.accept(ans), pred).collect()
    assert [(r.label_id, r.score) for r in rows] == [("gnd:2", 1.0)]


def test_one_sided_combine(spark):
    e = spark.createDataFrame([("d", "a", 0.5)], "doc_id string, label_id string, score double")
    r = spark.createDataFrame([("d", "b", 1.0)], "doc_id string, label_id string, score double")
    got = {x.label_id: x.score for x in C.combine(e, r, 0.3).collect()}
    assert got["a"] == pytest.approx(0.15) and got["b"] == pytest.approx(0.7)


def test_combine_out_of_range_fails(spark):
    e = spark.createDataFrame([("d", "a", 1.5)], "doc_id string, label_id string, score double")
    r = spark.createDataFrame([("d", "a", 1.0)], "doc_id string, label_id string, score double")
    with pytest.raises(Exception, match="between 0 and 1"):
        C.combine(e, r, 0.3).collect()


def test_empty_prediction_doc(spark):
    gold = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, label_id string")
    pred = spark.createDataFrame([("d1", "a")], "doc_id string, label_id string")
    got = {r.metric: r.value for r in V.set_scores(gold, pred).collect()}
    assert got == {"prec": 1.0, "rprec": 1.0, "rec": 0.5, "f1": 0.5}


def test_score_ties_share_rank_and_enter_together(spark):
    pred = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.5), ("d", "c", 0.5)],
                                 "doc_id string, label_id string, score double")
    ranks = [r["rank"] for r in V.rank_predictions(pred).collect()]
    assert ranks == [1, 1, 1]
    gold = spark.createDataFrame([("d", "a")], "doc_id string, label_id string")
    cell = V.pr_grid(gold, pred, steps=10).where("limit = 1 AND threshold = 0.5").collect()[0]
    assert cell.precision == pytest.approx(1 / 3) and cell.recall == 1.0


def test_unmapped_id_dropped_and_counted(spark):
    df = spark.createDataFrame([("d", "1"), ("d", "2")], "doc_id string, label_id string")
    table = spark.createDataFrame([("1", "X-1")], "idn string, gnd_id string")
    mapped, unmapped = M.translate_ids(df, table)
    assert [r.label_id for r in mapped.collect()] == ["gnd:X-1"]
    assert unmapped.count() == 1
    with pytest.raises(ValueError):
        M.translate_ids(df, table.withColumnRenamed("gnd_id", "g"))


def test_repeated_allow_list_id_same_rows(spark):
    df = spark.createDataFrame([("d", "gnd:1"), ("d", "gnd:2")], "doc_id string, label_id string")
    once = spark.createDataFrame([("gnd:1",)], "nid string")
    twice = spark.createDataFrame([("gnd:1",), ("gnd:1",)], "nid string")
    assert M.allow(df, once).collect() == M.allow(df, twice).collect()


def test_keyword_named_na_is_kept(spark):
    df = spark.createDataFrame([("m", "p", "d", "NA"), ("m", "p", "d", "null"), ("m", "p", "d", None)],
                               "model string, prompt string, doc_id string, candidate string")
    assert sorted(r.candidate for r in M.count_rows(df).collect()) == ["NA", "null"]


def test_threshold_nan_goes_nowhere(spark):
    df = spark.createDataFrame([(0.9,), (0.1,), (float("nan"),)], "cosine_similarity double")
    kept, removed = M.split_threshold(df, 0.7)
    assert kept.count() == 1 and removed.count() == 1


def test_title_without_abstract_fails_rank(spark):
    from subjex.functions.text import compose_content
    pred = spark.createDataFrame([("d", "l", "t")], "doc_id string, label_id string, term string")
    docs = spark.createDataFrame([("d", "T", None)], "doc_id string, title string, abstract string")
    content = docs.select("doc_id", compose_content(F.col("title"), F.col("abstract")).alias("content"))
    with pytest.raises(Exception, match="empty content"):
        R.relevance_prompts(pred, content, "{text}").collect()


def test_braces_in_text_leave_prompt_intact(spark):
    from subjex.functions.text import fill_prompt
    df = spark.createDataFrame([("a {x} b",)], "t string")
    got = df.select(fill_prompt(F.lit("<{text}>"), F.col("t")).alias("p")).first().p
    assert got == "<a {x} b>"


def test_include_and_sample_refused(spark):
    from subjex.operators.records import include_docs
    df = spark.createDataFrame([("d",)], "doc_id string")
    with pytest.raises(ValueError):
        include_docs(df, df, sample_size=3)


def test_sample_larger_than_set_returns_all(spark):
    from subjex.operators.records import stratified_sample
    df = spark.createDataFrame([(str(i), "de", "Book", "core") for i in range(5)],
                               "doc_id string, language string, text_type string, subjects string")
    assert stratified_sample(df, 50).count() == 5
    assert stratified_sample(df, 2).count() == 2


def test_float_helpers():
    assert math.isclose(0.3 * 0.5 + 0.7 * 0.0, 0.15)


@pytest.mark.parametrize("bits", [16, 4])
def test_stratified_sample_equals_window_definition(spark, bits):
    """The bucketed selection picks exactly the rows a per-stratum
    row_number over the seeded hash would pick."""
    from pyspark.sql import Window
    from subjex.operators.records import stratified_sample
    rows = [(f"d{i}", "de" if i % 3 else "en", "Book" if i % 7 else "Thesis", "core") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, language string, text_type string, subjects string")
    got = {r.doc_id for r in stratified_sample(df, 700, seed=5, bucket_bits=bits).collect()}
    by = ["subjects", "language", "text_type"]
    size = F.bround(F.lit(700.0) / 3000 * F.count(F.lit(1)).over(Window.partitionBy(*by)), 0)
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id")
    want = {r.doc_id for r in df.withColumn("_s", size).withColumn("_r", F.row_number().over(w))
            .where("_r <= _s").collect()}
    assert got == want and 690 <= len(got) <= 710
