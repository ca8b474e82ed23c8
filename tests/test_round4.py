"""Committed runs, resumable model calls, token budgets, a stream's best match, and small operators without a query of their own."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F


def _runs(spark, rows):
    return spark.createDataFrame(rows, "model string, prompt string, doc_id string, score double")


def test_a_replayed_append_leaves_one_copy(spark, tmp_path):
    from subjex.sources import sinks
    path = str(tmp_path / "runs")
    with pytest.raises(ValueError):
        sinks.read_runs(spark, path)
    first = _runs(spark, [("m/1", "01", "a", 0.1), ("m/1", "01", "b", 0.2), ("m2", "p=x", "a", 0.3)])
    sinks.append_runs(first, path)
    sinks.append_runs(first, path)
    more = _runs(spark, [("m2", "p=x", "c", 0.5), ("m3", "é", "a", 0.4)])
    assert sinks.commit_runs(more, path) == 3
    rows = lambda **k: sorted((r.model, r.prompt, r.doc_id, r.score) for r in sinks.read_runs(spark, path, **k).collect())
    assert rows() == [("m/1", "01", "a", 0.1), ("m/1", "01", "b", 0.2), ("m2", "p=x", "c", 0.5), ("m3", "é", "a", 0.4)]
    assert rows(runs=[("m/1", "01")]) == [("m/1", "01", "a", 0.1), ("m/1", "01", "b", 0.2)]
    # staged files without a manifest entry are those of a writer that failed
    _runs(spark, [("m9", "z", "x", 1.0)]).write.partitionBy("model", "prompt").parquet(f"{path}/data/batch=lost")
    assert len(rows()) == 4
    sinks.commit_runs(_runs(spark, [("m4", "q", "a", 0.9)]), path, drop=[("m2", "p=x")])
    assert {r[0] for r in rows()} == {"m/1", "m3", "m4"}


def test_a_lost_race_starts_again(spark, tmp_path, monkeypatch):
    from subjex.sources import sinks
    path, real, calls = str(tmp_path / "runs"), sinks.manifest, []
    sinks.append_runs(_runs(spark, [("a", "1", "x", 0.1)]), path)

    def late(s, p):
        found = real(s, p)
        if not calls:  # another writer commits after this one has read the manifest
            calls.append(1)
            sinks.commit_runs(_runs(spark, [("b", "1", "x", 0.2)]), path)
        return found
    monkeypatch.setattr(sinks, "manifest", late)
    assert sinks.commit_runs(_runs(spark, [("c", "1", "x", 0.3)]), path) == 3
    assert {r.model for r in sinks.read_runs(spark, path).collect()} == {"a", "b", "c"}


def test_metric_files_and_tables(spark, tmp_path):
    from subjex.operators.submit import write_submission
    from subjex.sources import sinks
    metrics = spark.createDataFrame([(m, v, l, "all") for l in ("all", "de") for m, v in (("prec", .5), ("rec", .25), ("f1", .3), ("rprec", .6))], "metric string, value double, language string, text_type string")
    folder = str(tmp_path / "m")
    assert sorted(sinks.write_metric_files(metrics, folder)) == ["f1_opt.json", "prec_opt.json", "rec_opt.json", "rprec_opt.json"]
    assert json.load(open(f"{folder}/prec_opt.json")) == {"prec_value": 0.5}
    assert sorted(sinks.write_metric_files(metrics, folder, set_only=True))[0] == "f1.json" and json.load(open(f"{folder}/rec.json")) == {"rec_value": 0.25}
    sinks.write_metrics_json(metrics, str(tmp_path / "wide"))
    assert spark.read.json(str(tmp_path / "wide")).first()["rprec_value"] == 0.6
    chain = spark.createDataFrame([("a_1", 0.5), ("b_2", 0.75)], "model_prompt string, cum_score double")
    sinks.write_table(chain, str(tmp_path / "chain"), "csv")
    assert sorted(map(tuple, spark.read.option("header", True).schema(chain.schema).csv(str(tmp_path / "chain")).collect())) == [("a_1", 0.5), ("b_2", 0.75)]
    plain = str(tmp_path / "plain")
    sinks.overwrite_runs(_runs(spark, [("a", "1", "x", 0.1), ("b", "1", "x", 0.2)]), plain)
    sinks.overwrite_runs(_runs(spark, [("b", "1", "y", 0.3)]), plain)
    assert sorted((r.model, r.doc_id) for r in spark.read.parquet(plain).collect()) == [("a", "x"), ("b", "y")]
    sub = spark.createDataFrame([("Book", "de", "d1", ["g:1", "g:2"])], "text_type string, language string, doc_id string, `dcterms:subject` array<string>")
    write_submission(sub, str(tmp_path / "sub"))
    back = spark.read.json(str(tmp_path / "sub")).first()
    assert (back["text_type"], back["language"], back["doc_id"], back["dcterms:subject"]) == ("Book", "de", "d1", ["g:1", "g:2"])


def test_a_restart_asks_nothing_twice(spark, tmp_path):
    from subjex.operators.infer import ask
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    os.makedirs(log)

    def model(fail_at=None):
        def fn(prompts):
            import uuid
            if fail_at is not None and len(os.listdir(log)) >= fail_at:
                raise RuntimeError("the model went away")
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                json.dump(prompts, f)
            return [p.upper() for p in prompts]
        return fn
    asked = lambda: [p for f in os.listdir(log) for p in json.load(open(f"{log}/{f}"))]
    rows = [(m, i, f"question {i % 30} " + "x" * (i % 7)) for m in ("a", "b") for i in range(60)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "model string, doc_id long, text string").repartition(3)
    n_questions = len({(m, t) for m, _, t in rows if t})
    with pytest.raises(Exception, match="went away"):
        ask(df, store, model(fail_at=14), batch=5, parts=8).collect()
    before = spark.read.parquet(store).count()
    got = {(r.model, r.doc_id): r.answer for r in ask(df, store, model(), batch=5, parts=8).collect()}
    assert got == {(m, i): t.upper() if t else None for m, i, t in rows}
    assert before > 0 and spark.read.parquet(store).count() == n_questions
    total = len(asked())
    assert ask(df, store, model(), parts=3).count() == len(rows) and len(asked()) == total
    more = df.unionByName(spark.createDataFrame([("c", 1, "question 1 x")], df.schema))
    assert ask(more, store, model()).count() == len(rows) + 1 and len(asked()) == total + 1


def test_token_budget_holds_when_encoded_again(spark):
    import public_tokenizers
    import tokenizers
    from subjex.operators.prompts import cut_to_tokens
    rng = random.Random(2)
    texts = ["", None, "one", "x" * 5000, "日本語のテキスト" * 50, "é́ " * 80] + ["".join(rng.choice("ab é日🙂 \n.,x") for _ in range(rng.randint(1, 900))) for _ in range(120)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    texts += [r.text for r in docs]
    for name, size in (("byte_bpe_50k.json", 40), ("word_bpe_49k.json", 25)):
        path = public_tokenizers.path(name)
        t = tokenizers.Tokenizer.from_file(path)
        n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
        frame = spark.createDataFrame(list(enumerate(texts)), "i long, content string").withColumn("extra", F.lit(1))
        cut = cut_to_tokens(frame, path, size).collect()
        assert len(cut) == len(texts) and cut[0].asDict().keys() == {"i", "content", "extra", "n_tokens"}
        for r in cut:
            whole = texts[r.i]
            if whole is None:
                assert r.content is None and r.n_tokens == 0
                continue
            assert whole.startswith(r.content) and r.n_tokens == n(r.content) <= size
            if n(whole) <= size:
                assert r.content == whole
            else:  # no later token end would do
                e = t.encode(whole, add_special_tokens=False)
                best = max((whole[:end] for _, end in e.offsets[:size + 1] if n(whole[:end]) <= size), key=len)
                assert len(r.content) >= len(best) - 4 and r.n_tokens >= size - 3
        assert cut_to_tokens(frame, path, F.col("extra") - 1).where("content <> ''").isEmpty()


def test_stream_keeps_the_best_match(spark, tmp_path):
    from subjex.operators.mapping import best_match
    from subjex.streaming import best_match_stream as S
    rng = random.Random(6)
    rows = [(f"m{rng.randint(0, 1)}", "01", f"d{rng.randint(0, 5)}", f"g{rng.randint(0, 4)}", rng.choice(["a", "b", "c", None]), "t", rng.choice([None, 0.5, 0.7, 0.7, 0.9]), rng.choice([None, 0.1, 0.4])) for _ in range(150)]
    schema = "model string, prompt string, doc_id string, label_id string, candidate string, term string, cosine_similarity double, hybrid_score double"
    rows = [r[:5] + (f"term {r[4]}",) + r[6:] for r in rows if r[4] is not None and r[6] is not None]
    want = sorted(map(tuple, best_match(spark.createDataFrame(rows, schema), by=["model", "prompt"]).select(*S.KEY, "candidate", "term", "cosine_similarity", "hybrid_score").collect()))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_state_store(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name, cuts in (("one", [len(rows)]), ("many", [10, 60, 61, len(rows)])):
            src = str(tmp_path / f"in-{name}")
            at = 0
            for k, stop in enumerate(cuts):
                again = rows[max(0, at - 7):stop]  # the last rows before arrive once more
                spark.createDataFrame(again, schema).coalesce(1).write.parquet(f"{src}/b{k}")
                at = stop
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
            out = str(tmp_path / f"out-{name}")
            q = S.write_changes(S.best_match_changes(stream), out, str(tmp_path / f"ck-{name}"))
            assert q.awaitTermination(300)
            assert sorted(map(tuple, S.current(spark, out).select(*S.KEY, "candidate", "term", "cosine_similarity", "hybrid_score").collect())) == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_rank_frame_holds_the_confidence_bounds(spark):
    from subjex.operators.prompts import CHATML
    from subjex.operators.ranking import rank_frame, relevance_prompts
    frame = rank_frame(CHATML, "Von {min_confidence} bis {max_confidence}, {braces} bleiben.", 1, 5)
    assert "Von 1 bis 5, {braces} bleiben." in frame and frame.count("{text}") == 1 and "assistant" not in frame
    pred = spark.createDataFrame([("d", "t")], "doc_id string, term string")
    content = spark.createDataFrame([("d", "inhalt")], "doc_id string, content string")
    prompt = relevance_prompts(pred, content, frame).first().prompt
    assert "Text: inhalt\nSchlagwort:t" in prompt and "bis 5" in prompt
    with pytest.raises(ValueError):
        rank_frame(CHATML, "no bounds")


def test_small_functions(spark):
    from subjex.functions.text import safe_int, split_arg, str2bool
    from subjex.operators import checks
    from subjex.sources.records import validate_domain
    row = spark.createDataFrame([("7", "x", None, "Yes ", "0", "maybe")], "a string, b string, c string, d string, e string, f string").select(
        safe_int(F.col("a")), safe_int(F.col("b")), safe_int(F.col("c")), str2bool(F.col("d")), str2bool(F.col("e")), str2bool(F.col("f"))).first()
    assert tuple(row) == (7, 0, 0, True, False, None)
    assert split_arg("dev-test-") == ["dev", "test"]
    for bad in ((["x"], [], [], []), ([], ["x"], [], []), ([], [], ["x"], []), ([], [], [], ["x"])):
        with pytest.raises(ValueError):
            validate_domain(*bad)
    gold = spark.createDataFrame([("d", "l"), ("d", "m")], "doc_id string, label_id string")
    assert checks.check_gold(gold).count() == 2 and checks.assert_not_empty(gold, "gold").count() == 2
    for bad, text in ((gold.unionByName(gold), "non-unique"), (gold.withColumn("label_id", F.lit(None).cast("string")).limit(1), "missing")):
        with pytest.raises(ValueError, match=text):
            checks.check_gold(bad)
    with pytest.raises(ValueError, match="No documents"):
        checks.assert_not_empty(gold.limit(0), "gold")


def test_dimension_files_and_the_run_matrix(spark, tmp_path):
    from subjex.operators.prompts import CHATML, prompt_frames
    from subjex.sources.prompts import scan_model_templates, scan_templates
    from subjex.sources.tables import read_dataset_csv, read_id_list
    os.makedirs(tmp_path / "t")
    json.dump(CHATML, open(tmp_path / "t" / "chatml.json", "w"))
    json.dump({**CHATML, "example": "[{text}]", "test_item": "<{text}>"}, open(tmp_path / "t" / "other.json", "w"))
    json.dump({"m1": "chatml.json", "m/2": "other.json"}, open(tmp_path / "map.json", "w"))
    templates, models = scan_templates(spark, str(tmp_path / "t")), scan_model_templates(spark, str(tmp_path / "map.json"))
    ex = spark.createDataFrame([("p", 1, "t1", "k1"), ("q", 1, "t2", "k2")], "prompt string, ord int, text string, keywords string")
    runs = models.select("model").crossJoin(ex.select("prompt").distinct())
    frames = {(r.model, r.prompt): r.frame for r in prompt_frames(runs, models, templates, ex, "Hallo").collect()}
    assert len(frames) == 4 and frames["m/2", "q"].startswith("<|im_start|>system\nHallo") and "[t2]" in frames["m/2", "q"] and frames["m/2", "q"].endswith("<{text}>")
    with open(tmp_path / "ids.csv", "w") as f:
        f.write("idn\n3A1\n3A2\n3A1\n")
    assert sorted(r.doc_id for r in read_id_list(spark, str(tmp_path / "ids.csv")).collect()) == ["3A1", "3A2"] and read_id_list(spark, None) is None
    with open(tmp_path / "d.csv", "w") as f:
        f.write("language,split,text_type,subjects,doc_id,title,abstract,dcterms:subject,labels\n"
                "de,dev,Book,all-subjects,3A1,\"T\nU\",A,\"['gnd:1', 'gnd:2']\",\"['x', \"\"it's\"\"]\"\n")
    r = read_dataset_csv(spark, str(tmp_path / "d.csv")).first()
    assert (r.title, r["dcterms:subject"], r.labels) == ("T\nU", ["gnd:1", "gnd:2"], ["x", "it's"])


def test_vocabulary_build_with_a_phrase(spark):
    from subjex.operators.infer import HashedNgramEncoder
    from subjex.sources.vocab import ALT_LABEL, PREF_LABEL, build_vocab
    t = spark.createDataFrame([("x/4-1", PREF_LABEL, "Café"), ("x/4-1", ALT_LABEL, "Kaffee"), ("x/4-1", "other", "no")], "s string, p string, o string")
    v = {r.label_text: r for r in build_vocab(t, HashedNgramEncoder(), phrase="Begriff: ").collect()}
    assert set(v) == {"Begriff: Café", "Begriff: Kaffee"} and abs(sum(x * x for x in v["Begriff: Kaffee"].embedding) - 1) < 1e-5


def test_ordinal_grid_and_unjudged_documents(spark):
    from subjex.operators import evaluate as V
    gold = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "c")], "doc_id string, label_id string")
    pred = spark.createDataFrame([("d1", "a", .9), ("d1", "x", .8), ("d1", "b", .7), ("d9", "z", .5)], "doc_id string, label_id string, score double")
    grid = {r.limit: (r.threshold, r.precision, round(r.recall, 9)) for r in V.pr_grid(gold, pred, ordinal=True).collect()}
    assert grid == {1: (0.0, 1.0, .25), 2: (0.0, .5, .25), 3: (0.0, pytest.approx(2 / 3), .5)}
    judged = {r.metric: r.value for r in V.set_scores(gold, pred).collect()}
    unjudged = {r.metric: r.value for r in V.set_scores(gold, pred, include_unjudged=True).collect()}
    assert judged["prec"] == pytest.approx(2 / 3) and judged["rec"] == .5 and judged["f1"] == pytest.approx(.4)
    # d9 has no gold label: precision 0, F1 0, and no recall to average
    assert unjudged["prec"] == pytest.approx(1 / 3) and unjudged["f1"] == pytest.approx(.8 / 3)


def test_debug_rows_limit_the_map_stage(spark):
    from subjex.operators.infer import HashedNgramEncoder, embed
    from subjex.plans.pipelines import map_stage
    vocab = embed(spark.createDataFrame([("1", "cat"), ("2", "dog")], "label_id string, label_text string"), "label_text", encode=HashedNgramEncoder())
    comp = spark.createDataFrame([("m", "p", f"d{i}", "cat") for i in range(9)], "model string, prompt string, doc_id string, candidate string")
    best, _, _ = map_stage(comp, vocab, min_cosine=0.1, score_param="cosine_similarity", encode=HashedNgramEncoder(), debug_rows=4)
    assert best.count() == 4
