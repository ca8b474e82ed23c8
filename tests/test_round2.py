"""Findings of the first round, each with the case that showed it."""

import os

from pyspark.sql import functions as F

from subjex.functions.scores import stable_round
from subjex.functions.text import cut_words
from subjex.operators.knn import nearest


def test_records_of_any_file_name(spark, tmp_path):
    from subjex.sources.records import scan_records  # builds columns at import, so after the session
    body = '{"@graph": [{"@id": "https://www.tib.eu/x#%s", "dcterms:identifier": "1", "title": "T", "abstract": "A"}]}'
    folder = tmp_path / "core" / "data" / "train" / "Article" / "en"
    os.makedirs(folder)
    for name in ("a.json", "b.jsonld", "c"):
        (folder / name).write_text(body % name)
    args = (["core"], ["train"], ["Article"], ["en"])
    try:
        got = scan_records(spark, str(tmp_path), *args)
    except ValueError:
        args = (["all-subjects"], *args[1:])
        os.rename(tmp_path / "core", tmp_path / "all-subjects")
        got = scan_records(spark, str(tmp_path), *args)
    assert {r.file_path.rsplit("/", 1)[-1] for r in got.select("file_path").distinct().collect()} == {"a.json", "b.jsonld", "c"}


def test_ntriples_tags_and_escapes(spark, tmp_path):
    from subjex.sources.vocab import scan_ntriples
    rows = {r'"über"@de-1996': "über", r'"a\\"@en': "a\\", r'"say \"hi\"\n"': 'say "hi"\n', r'"it\'s"@en-GB': "it's", r'"tab\there"^^<http://t>': "tab\there", '"plain"': "plain", r'"\\u0041"': "\\u0041"}
    path = tmp_path / "v.nt"
    path.write_text("".join(f"<http://s/{i}> <http://p> {o} .\n" for i, o in enumerate(rows)), encoding="utf-8")
    got = {r.s: r.o for r in scan_ntriples(spark, str(path)).collect()}
    assert got == {f"http://s/{i}": v for i, v in enumerate(rows.values())}


def test_rounding_of_large_values(spark):
    values = [1234567890123.0, -9.3e9, 8.9e9, 0.1234565, 1e300]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(stable_round(F.col("x"))).collect()]
    assert got == [1234567890123.0, -9.3e9, 8.9e9, 0.123457, 1e300]


def test_text_within_the_budget_stays(spark):
    text = "two  spaces\nand lines"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cut_words(F.col("t"), 4), cut_words(F.col("t"), 3)).first()[:] == (text, "two spaces and")


def test_nearest_label_rows_with_alternatives(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    v = spark.createDataFrame([("a", "zeta", [1.0, 0.0]), ("a", "alpha", [1.0, 0.0]), ("b", "x", [0.0, 1.0])], "label_id string, label_text string, embedding array<double>")
    got = sorted((-r.cosine, r.label_id, r.label_text) for r in nearest(q, v, k=2).collect())
    assert [x[1:] for x in got] == [("a", "alpha"), ("a", "zeta")]


VOCAB = [("a", "cat", [1.0, 0.0]), ("a", "feline animal", [0.6, 0.8]), ("b", "dog", [0.0, 1.0])]


def test_keyword_search_scores_label_rows(spark):
    import math
    from subjex.operators.bm25 import bm25
    v = spark.createDataFrame([x[:2] for x in VOCAB], "label_id string, label_text string")
    q = spark.createDataFrame([(1, "cat"), (2, "animal dog"), (3, "bird")], "query_id long, query string")
    got = {(r.query_id, r.label_id): r.score for r in bm25(q, v, k=5).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    score = lambda length: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / (4 / 3)))
    want = {(1, "a"): score(1), (2, "a"): score(2), (2, "b"): score(1)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_hybrid_returns_the_label_row_that_won(spark):
    from subjex.operators.bm25 import hybrid
    v = spark.createDataFrame(VOCAB, "label_id string, label_text string, embedding array<double>")
    q = spark.createDataFrame([(1, "cat", [1.0, 0.0]), (2, "feline", [0.6, 0.8])], "query_id long, query string, embedding array<double>")
    got = sorted((r.query_id, r.label_id, r.term, round(r.cosine, 9)) for r in hybrid(q, v).collect())
    assert got == [(1, "a", "cat", 1.0), (2, "a", "feline animal", 1.0)]


def test_subtract_member_is_the_mean_of_the_others(spark):
    from subjex.operators.ensemble import fused_mean, subtract_member
    rows = [("m1", "p", 1, "x", 0.5), ("m2", "p", 1, "x", 0.25), ("m1", "p", 1, "y", 0.5), ("m3", "p", 2, "x", 0.75)]
    pred = spark.createDataFrame(rows, "model string, prompt string, doc_id long, label_id string, score double")
    members = lambda *m: spark.createDataFrame([("e", x, "p", i) for i, x in enumerate(m)], "ensemble string, model string, prompt string, ord int")
    got = subtract_member(fused_mean(pred, members("m1", "m2", "m3")), pred.where("model = 'm1'"), 3)
    key = lambda df: {(r.doc_id, r.label_id): round(r.score, 9) for r in df.collect()}
    assert key(got) == key(fused_mean(pred, members("m2", "m3")))
    assert subtract_member(fused_mean(pred, members("m1")), pred.where("model = 'm1'"), 1).count() == 0


def test_replayed_batch_counts_once(spark, tmp_path):
    from subjex.streaming import mapping_stream as S
    vocab = spark.createDataFrame(VOCAB, "label_id string, label_text string, embedding array<double>")
    vector = {"cat": [1.0, 0.0], "dog": [0.0, 1.0], "ox": [0.7, 0.7]}
    encode = lambda texts: [vector[t] for t in texts]
    answers = lambda *a: spark.createDataFrame([("m", "01", str(i), t) for i, t in enumerate(a)], S.RESPONSE_SCHEMA)
    paths = str(tmp_path / "matches"), str(tmp_path / "pred")
    removed = str(tmp_path / "removed")
    for epoch, batch in ((0, answers("cat", "dog")), (1, answers("dog, ox")), (1, answers("dog, ox"))):
        S.map_batch(batch, vocab, *paths, min_cosine=0.995, encode=encode, epoch=epoch, removed_path=removed)
    assert sorted(r.candidate for r in spark.read.parquet(paths[0]).collect()) == ["cat", "dog", "ox"]
    assert spark.read.parquet(paths[1]).count() == 3 and spark.read.parquet(removed).count() == 1
    assert {r.prompt for r in S.finalise(spark, paths[1]).collect()} == {"01"}


def test_documents_without_content_are_known(spark):
    from subjex.plans.pipelines import without_content
    docs = spark.createDataFrame([(1, "t", None), (2, None, None), (3, None, "a")], "doc_id long, title string, abstract string")
    assert [r.doc_id for r in without_content(docs).collect() if r.doc_id == 2] == [2]


def _counts(texts):
    import numpy as np
    return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)


def test_embed_needs_an_encoder(spark):
    import pytest
    from subjex.operators.infer import embed
    with pytest.raises(ValueError):
        embed(spark.createDataFrame([("x",)], "t string"), "t")


def test_prompt_budget_from_the_frame(spark):
    from subjex.operators.prompts import fill
    frames = spark.createDataFrame([("m", "p", "ask now: {text} end")], "model string, prompt string, frame string")
    docs = spark.createDataFrame([(1, "a  b\nc"), (2, "a b c d e f"), (3, "")], "doc_id long, content string")
    got = {r.doc_id: r.text for r in fill(docs, frames, "m", "p", max_total=10, max_new=3).collect()}  # 10 - 3 - 3 words
    assert got == {1: "ask now: a  b\nc end", 2: "ask now: a b c d end", 3: "ask now:  end"}
    tight = {r.doc_id: r.text for r in fill(docs, frames, "m", "p", max_total=5, max_new=3).collect()}
    assert tight[2] == "ask now:  end"
    assert fill(docs, frames, "m", "p").where("doc_id = 2").first().text == "ask now: a b c d e f end"


def test_examples_without_a_part_have_no_text(spark):
    from subjex.operators.prompts import sample_examples
    rows = spark.createDataFrame([(1, "T", None, ["k"]), (2, "T", "A", ["k", "l"])], "doc_id long, title string, abstract string, labels array<string>")
    assert {r.doc_id: r.text for r in sample_examples(rows, "both", 5).collect()} == {1: None, 2: "T A"}


def test_map_stage_by_clusters_and_unmapped_ids(spark):
    from subjex.operators.infer import embed
    from subjex.plans.pipelines import map_stage
    words = ["apple", "pear", "quince", "melon", "fig", "grape", "mango", "cherry", "plum"]
    vocab = embed(spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "label_id string, label_text string"), "label_text", encode=_counts)
    comp = spark.createDataFrame([("m", "p", d, w) for d, w in enumerate([*words, "plum"])], "model string, prompt string, doc_id long, candidate string")
    ids = spark.createDataFrame([(str(i), str(100 + i)) for i in range(8)], "idn string, gnd_id string")  # none for plum
    args = dict(encode=_counts, min_cosine=0.5, score_param="cosine_similarity", id_table=ids)
    rows = []
    for search in ({"search": "vector"}, {"search": "clusters", "n_probe": 3}):
        best, _, stats = map_stage(comp, vocab, **search, **args)
        rows.append(sorted((r.doc_id, r.label_id) for r in best.collect()))
        assert [r.n_unmapped_ids for r in stats.collect()] == [2]
    assert rows[0] == rows[1] == [(d, f"gnd:{100 + d}") for d in range(8)]
