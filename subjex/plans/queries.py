"""Registered queries: each reads the driver's tables at ``sf_dir`` (whole
tables), runs one operator family end to end and returns a DataFrame whose
column names equal those of the matching oracle SQL in ``oracle.py``.

Doubles are rounded to 6 digits on both sides; scores that are sums of
floats are rounded to 9 digits before they are ranked or compared, so that
summation order cannot split a tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from subjex.functions.scores import stable_round
from subjex.functions.text import answer_keywords, compose_content, cut_words
from subjex.operators import combine as C
from subjex.operators import ensemble as E
from subjex.operators import evaluate as V
from subjex.operators import mapping as M
from subjex.operators import ranking as R
from subjex.plans import fixtures as X

MEMBER = ["model", "prompt"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[stable_round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ------------------------------------------------------------- mapping

def q_best_match(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.best_match(X.pred(spark, sf), by=MEMBER))


def _allowed(spark, sf):
    return X.table(spark, sf, "part").where(F.col("p_size") <= 40) \
        .select(F.concat(F.lit("gnd:"), F.col("p_partkey").cast("string")).alias("nid"))


def q_threshold_split(spark: SparkSession, sf: str) -> DataFrame:
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "candidate", "cosine_similarity")
    kept, removed = M.split_threshold(p, 0.7)
    return rounded(kept.withColumn("side", F.lit("kept"))
                   .unionByName(removed.withColumn("side", F.lit("removed"))))


def q_map_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = X.pred(spark, sf)
    kept, removed = M.split_threshold(p, 0.7)
    allowed = M.allow(kept, _allowed(spark, sf))
    best = M.best_match(allowed, by=MEMBER)
    return M.map_stats(best, removed, kept, allowed, by=MEMBER) \
        .select(*MEMBER, "n_keywords", "n_matches_below_threshold", "n_not_in_allowed_subjects")


# ------------------------------------------------------------- ensemble

def _vote(spark, sf, pred=None):
    return E.vote(X.pred(spark, sf) if pred is None else pred, X.members(spark, sf)) \
        .withColumn("score", stable_round(F.col("score"), 9))


def q_ensemble_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_vote(spark, sf))


def _ranked(spark, sf):
    acc = R.accept(X.relevance_answers(spark, sf), threshold=0.0, max_suggestions=50)
    return R.normalise_relevance(acc, X.rank_input(spark, sf).select("doc_id", "label_id", "term"))


def q_combine(spark: SparkSession, sf: str) -> DataFrame:
    e = _vote(spark, sf).where(F.col("ensemble") == "all").drop("ensemble")
    out = C.combine(e, _ranked(spark, sf), weight=0.3)
    return rounded(out.select("doc_id", "label_id", "score_ensemble", "score_relevance", "score"))


def q_rank_min(spark: SparkSession, sf: str) -> DataFrame:
    small, large = V.by_document_size(X.pred(spark, sf))
    votes = lambda p: _vote(spark, sf, p).select("ensemble", "doc_id", "label_id", "score")
    ranks = V.rank_predictions(votes(small), by=["ensemble"], whole=True)
    return rounded(ranks if large is None else ranks.unionByName(V.rank_predictions(votes(large), by=["ensemble"])))


def q_cap_alphabetical(spark: SparkSession, sf: str) -> DataFrame:
    acc = R.accept(X.relevance_answers(spark, sf), threshold=1.0, max_suggestions=2)
    return rounded(acc.select("doc_id", "term", "relevance"))


def q_relevance_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ranked(spark, sf))


# ------------------------------------------------------------- evaluation

def q_gold_explode(spark: SparkSession, sf: str) -> DataFrame:
    return V.gold_from_dataset(X.dataset(spark, sf))


def q_set_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.set_scores(X.gold(spark, sf), X.pred(spark, sf), by=MEMBER))


def q_strata_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.strata_scores(X.gold(spark, sf), X.pred(spark, sf), by=MEMBER))


def q_micro_f1_at_5(spark: SparkSession, sf: str) -> DataFrame:
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "score")
    return rounded(V.f1_at_k(X.gold(spark, sf), p, k=5, by=MEMBER))


def _member_grid(spark, sf, dense=True):
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "score")
    return V.pr_grid(X.gold(spark, sf), p, by=MEMBER, steps=100, dense=dense)


def q_pr_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_member_grid(spark, sf))


def q_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.pr_auc(V.pr_curve(_member_grid(spark, sf), by=MEMBER), by=MEMBER))


def q_opt_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.opt_cutoff(_member_grid(spark, sf), by=MEMBER))


def q_pivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = V.set_scores(X.gold(spark, sf), X.pred(spark, sf), by=MEMBER)
    return rounded(V.pivot_metrics(s, by=MEMBER).drop(*V.STRATA))


def q_candidates_auc(spark: SparkSession, sf: str) -> DataFrame:
    """O3 + T5: every candidate ensemble scored in one job, best ten kept."""
    from subjex.operators.search import score_ensembles
    return rounded(score_ensembles(X.pred(spark, sf), X.members(spark, sf), X.gold(spark, sf), top=10))


def q_subtract_member(spark: SparkSession, sf: str) -> DataFrame:
    """J10 + P6 + P8: the fused mean of all members without member (A, F)."""
    p = X.pred(spark, sf)
    mem = X.members(spark, sf).where(F.col("ensemble") == "all")
    fused = E.fused_mean(p, mem).drop("ensemble")
    one = p.where((F.col("model") == "A") & (F.col("prompt") == "F"))
    return rounded(E.subtract_member(fused, one, mem.select(F.count(F.lit(1))).scalar()))


# ------------------------------------------------------------- text

def q_parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    r = X.responses(spark, sf)
    return r.select(*MEMBER, "doc_id", F.explode(answer_keywords(F.col("answer"))).alias("candidate"))


def q_content_truncate(spark: SparkSession, sf: str) -> DataFrame:
    d = X.docs(spark, sf)
    content = compose_content(F.col("title"), F.col("abstract"), "both")
    words = F.size(F.split(F.regexp_replace(content, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""), r"[ \t\n\r\f]+", -1))
    return d.select("doc_id", words.alias("n_words"),
                    cut_words(content, 4096 - 100 - 320).alias("content"))


def q_submission(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.submit import submission
    v = _vote(spark, sf).where(F.col("ensemble") == "all").select("doc_id", "label_id", "score")
    return submission(v, X.strata(spark, sf))


# ------------------------------------------------------------- search

def q_knn_top1(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.knn import nearest
    return rounded(nearest(X.vec_queries(spark, sf), X.vec_vocab(spark, sf), k=1))


def q_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.knn import nearest
    return rounded(nearest(X.vec_queries(spark, sf), X.vec_vocab(spark, sf), k=5))


def q_knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.knn import nearest_clusters
    return rounded(nearest_clusters(X.vec_queries(spark, sf), X.vec_vocab(spark, sf), k=1, n_clusters=8))


def q_knn_ivf_all(spark: SparkSession, sf: str) -> DataFrame:
    """M4, exact: two clusters probed, all others that their radius does not rule out after them."""
    from subjex.operators.knn import nearest_clusters
    return rounded(nearest_clusters(X.vec_queries(spark, sf), X.vec_vocab(spark, sf), k=5, n_clusters=8, n_probe=2, exact=True))


def q_bm25_top1(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.bm25 import bm25
    return rounded(bm25(X.text_queries(spark, sf), X.text_corpus(spark, sf), k=1).drop("row"))


def q_hybrid_top1(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.bm25 import hybrid
    from subjex.session import cut_lineage
    items = cut_lineage(X.hybrid_items(spark, sf))  # queries and labels come from one join
    q = items.where(F.col("label") == 0).select(F.col("item_id").alias("query_id"), "embedding",
                                                F.col("text").alias("query"))
    v = items.where(F.col("label") != 0).select(F.col("item_id").cast("string").alias("label_id"),
                                                F.col("text").alias("label_text"), "embedding")
    return rounded(hybrid(q, v, alpha=0.7, depth=10))


# ------------------------------------------------------------- sources / dataset

def q_vocab_labels(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.sources.vocab import vocab_labels
    return vocab_labels(X.triples(spark, sf), use_alt=True)


def q_records(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.sources.records import extract_records
    return extract_records(X.records_json(spark, sf), "json")


def _two_splits(spark, sf):
    d = X.docs(spark, sf)
    return d.where(F.col("language") == "de").withColumn("split", F.lit("dev")) \
        .unionByName(d.withColumn("split", F.lit("train")))


def q_dedupe_docs(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.records import dedupe_docs, exclude_docs, include_docs
    lab = X.table(spark, sf, "labels")
    deny = lab.where(F.col("toxic") == 1).select("doc_id")
    allow = lab.select("doc_id")
    out = include_docs(exclude_docs(dedupe_docs(_two_splits(spark, sf)), deny), allow)
    return out.select("doc_id", "split", "language", "text_type")


def q_sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.records import stratified_sample
    d = X.docs(spark, sf).withColumn("subjects", F.lit("all-subjects"))
    s = stratified_sample(d, 300, seed=42)
    return s.groupBy("language", "text_type").agg(F.count(F.lit(1)).alias("n_sampled"))


def q_render_prompts(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.prompts import CHATML, render_examples
    return render_examples(X.examples(spark, sf), CHATML, instruction="Nenne treffende Begriffe")


def q_embed_batch(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.infer import embed
    vectors = embed(X.table(spark, sf, "documents").select("doc_id", "text"), "text", encode=X.letter_counts, batch=32)
    return rounded(vectors.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
                   .withColumn("value", F.col("value").cast("double")))


# ------------------------------------------------------------- ensemble search

def q_greedy_forward(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.search import greedy_forward
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "score")
    return rounded(greedy_forward(p, X.gold(spark, sf)))


def q_greedy_recurrent(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.search import greedy_forward
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "score")
    return rounded(greedy_forward(p, X.gold(spark, sf), weights="recurrent"))


def q_greedy_backward(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.search import greedy_backward
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "score")
    initial, chain = greedy_backward(p, X.gold(spark, sf))
    return rounded(chain.withColumn("initial", F.lit(initial)))


def q_sample_ensembles(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.operators.search import sample_ensembles, score_ensembles
    p = X.pred(spark, sf)
    existing = E.existing_members(p, big_models=["R"])
    cands = sample_ensembles(existing, n=3, max_big=1, samples=8, seed=1)
    return rounded(score_ensembles(p, cands, X.gold(spark, sf), top=10))


def q_map_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """M9 end to end: keywords parsed from the assistant answers mapped onto
    a vocabulary of part names and types (embedded by their letter counts)."""
    from subjex.operators.infer import completions, embed
    from subjex.operators.knn import spread
    from subjex.plans.pipelines import map_stage
    from subjex.session import cut_lineage
    from subjex.sources.vocab import vocab_labels
    comp = completions(X.responses(spark, sf))
    vocab = cut_lineage(embed(vocab_labels(spread(X.triples(spark, sf))), "label_text", encode=X.letter_counts))  # the built vocabulary (M8)
    best, _removed, _stats = map_stage(comp, vocab, search="vector", min_cosine=0.3,
                                       score_param="cosine_similarity", encode=X.letter_counts)
    return rounded(best)


# ------------------------------------------------------------- more joins / stages

def q_unpredicted_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Gold documents that an ensemble predicts nothing for, of all runs ('all') and of the other fixed ensembles."""
    return V.unpredicted_docs(X.gold(spark, sf), X.pred(spark, sf), X.members(spark, sf))


def _one_run(spark, sf):
    return X.pred(spark, sf).where((F.col("model") == "A") & (F.col("prompt") == "F"))


def q_match_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of one run (A, F) and of gold matched both ways: rows left of each document on each side."""
    g, p = V.match_docs(X.gold(spark, sf), _one_run(spark, sf))
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold_rows")).join(
        p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pred_rows")), "doc_id", "full_outer")


def prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt-file lines made from conversations: user turns as ``Text:``,
    assistant turns as ``Schlagwörter:``, system turns as ``IDN:`` lines."""
    c = X.table(spark, sf, "conversations")
    body = F.regexp_replace(F.col("text"), "\n", " ")
    line = (F.when(F.col("role") == "user", F.concat(F.lit("Text: "), body))
            .when(F.col("role") == "assistant", F.concat(F.lit("Schlagwörter: "), body))
            .otherwise(F.concat(F.lit("IDN: "), body)))
    return c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("prompt"),
                    F.col("turn").alias("line_no"), line.alias("line"))


def q_prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    from subjex.sources.prompts import parse_prompt_lines
    return parse_prompt_lines(prompt_lines(spark, sf))


def q_translate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """J4 + P4 + N10: internal ids (part keys) to external ids (brands) with
    prefix; parts above size 45 have no mapping and are dropped."""
    p = X.pred(spark, sf).select("model", "prompt", "doc_id",
                                 F.regexp_replace("label_id", "^gnd:", "").alias("label_id"))
    table = X.table(spark, sf, "part").where(F.col("p_size") <= 45) \
        .select(F.col("p_partkey").cast("string").alias("idn"), F.col("p_brand").alias("gnd_id"))
    mapped, _unmapped = M.translate_ids(p, table)
    return mapped


def _stub_keywords(prompts):
    """Stand-in generator: the first five distinct words (over 3 letters) of
    the document inside each prompt, comma separated (deterministic)."""
    from subjex.operators.prompts import CHATML
    before, after = CHATML["example"].split("{text}")
    out = []
    for p in prompts:
        doc = p.rsplit(before, 1)[-1].split(after, 1)[0]
        seen = []
        for w in doc.replace(",", " ").replace(".", " ").split():
            if len(w) > 3 and w not in seen:
                seen.append(w)
            if len(seen) == 5:
                break
        out.append(", ".join(seen) + "\nmore text")
    return out


def _stub_relevance(prompts):
    """Stand-in relevance model: the term's length modulo one more than the greatest value that the prompt allows."""
    from subjex.operators.prompts import CHATML
    after, out = CHATML["example"].split("{text}")[1], []
    for p in prompts:
        highest = int(p.split("bis ", 1)[1].split(".", 1)[0])
        term = p.rsplit("\nSchlagwort:", 1)[-1].split(after, 1)[0]
        out.append(f"Relevanz: {len(term) % (highest + 1)}")
    return out


def run_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The run matrix of the complete query: two models by the three prompt files with most examples."""
    from subjex.operators.prompts import CHATML, render_examples
    ex = X.examples(spark, sf)
    top = ex.groupBy("prompt").count().orderBy(F.desc("count"), "prompt").limit(3).select("prompt")
    frames = render_examples(ex.join(top, "prompt", "left_semi"), CHATML)
    return frames.withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"))))


def q_complete_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Complete stage for a whole run matrix: frames, fill, ask (stand-in model) through an answer store, parse."""
    from subjex.plans.pipelines import complete_runs
    return complete_runs(X.docs(spark, sf), run_frames(spark, sf), _folder(spark, "answers"), _stub_keywords, max_total=16384, max_new=100, parts=2)


def _folder(spark, name):
    """A fresh folder below the shared checkpoint folder."""
    import uuid
    from subjex.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_rank_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Rank stage over the 'all' ensemble's documents that the document table holds: one
    question per (doc, distinct term) with confidence bounds, stand-in model, parse, accept, normalise."""
    from subjex.operators.prompts import CHATML
    from subjex.operators.ranking import rank_frame
    from subjex.plans.pipelines import rank_stage
    d = X.docs(spark, sf).where("title is not null").withColumn("abstract", F.coalesce("abstract", F.lit("")))
    e = _vote(spark, sf).where(F.col("ensemble") == "all").join(d.select("doc_id"), "doc_id", "left_semi")
    frame = rank_frame(CHATML, "Bewerte die Relevanz von {min_confidence} bis {max_confidence}.", 0, 10)
    return rounded(rank_stage(e, d, frame, _stub_relevance, threshold=0.0, max_suggestions=50))


# ------------------------------------------------------------- written and read back

def q_scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents written as CSV (quoted line ends, doubled quotes) and read back by many tasks."""
    from subjex.sources.tables import read_csv
    path = _folder(spark, "csv")
    d = X.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    back = read_csv(spark, path, "doc_id string, lang string, text string")
    text = F.coalesce("text", F.lit(""))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length(text).alias("n"), F.sha2(text, 256).alias("sha256"))


def q_scan_turtle(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the vocabulary written as Turtle statements and read back."""
    from subjex.sources.turtle import scan_turtle
    from subjex.sources.vocab import vocab_labels
    path = _folder(spark, "turtle")
    p = X.table(spark, sf, "part")
    text = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"')
    statement = F.concat(F.lit("@prefix s: <http://www.w3.org/2004/02/skos/core#> .\n<https://example.org/gnd/"), F.col("p_partkey").cast("string"),
                         F.lit('> s:prefLabel "'), text("p_name"), F.lit('"@en ;\n  s:altLabel """'), text("p_type"), F.lit('""" .'))
    p.select(statement.alias("value")).write.text(path)
    return vocab_labels(scan_turtle(spark, path), use_alt=True)


def q_append_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run appended, and one of them once more: its rows count once."""
    from subjex.sources.sinks import append_runs, read_runs
    path = _folder(spark, "runs")
    p = X.pred(spark, sf).select(*MEMBER, "doc_id", "label_id", "score")
    append_runs(p, path)
    append_runs(_one_run(spark, sf).select(p.columns), path)
    return rounded(read_runs(spark, path).select(p.columns))


def q_token_cut(spark: SparkSession, sf: str) -> DataFrame:
    """F8: whole documents cut to 100 tokens of a given tokenizer, at a token's end."""
    import public_tokenizers
    from subjex.operators.prompts import cut_to_tokens
    d = X.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return cut_to_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), 100).select("doc_id", "n_tokens", F.length("content").alias("n_chars"))


REGISTRY = {
    "q_best_match": q_best_match,
    "q_threshold_split": q_threshold_split,
    "q_map_stats": q_map_stats,
    "q_ensemble_vote": q_ensemble_vote,
    "q_combine": q_combine,
    "q_rank_min": q_rank_min,
    "q_cap_alphabetical": q_cap_alphabetical,
    "q_relevance_norm": q_relevance_norm,
    "q_gold_explode": q_gold_explode,
    "q_set_scores": q_set_scores,
    "q_strata_scores": q_strata_scores,
    "q_micro_f1_at_5": q_micro_f1_at_5,
    "q_pr_grid": q_pr_grid,
    "q_pr_auc": q_pr_auc,
    "q_opt_cutoff": q_opt_cutoff,
    "q_pivot_metrics": q_pivot_metrics,
    "q_candidates_auc": q_candidates_auc,
    "q_subtract_member": q_subtract_member,
    "q_parse_answers": q_parse_answers,
    "q_content_truncate": q_content_truncate,
    "q_submission": q_submission,
    "q_knn_top1": q_knn_top1,
    "q_knn_topk": q_knn_topk,
    "q_knn_ivf": q_knn_ivf,
    "q_knn_ivf_all": q_knn_ivf_all,
    "q_bm25_top1": q_bm25_top1,
    "q_hybrid_top1": q_hybrid_top1,
    "q_vocab_labels": q_vocab_labels,
    "q_records": q_records,
    "q_dedupe_docs": q_dedupe_docs,
    "q_sample_sizes": q_sample_sizes,
    "q_render_prompts": q_render_prompts,
    "q_embed_batch": q_embed_batch,
    "q_greedy_forward": q_greedy_forward,
    "q_greedy_recurrent": q_greedy_recurrent,
    "q_greedy_backward": q_greedy_backward,
    "q_sample_ensembles": q_sample_ensembles,
    "q_map_pipeline": q_map_pipeline,
    "q_unpredicted_docs": q_unpredicted_docs,
    "q_match_docs": q_match_docs,
    "q_prompt_lines": q_prompt_lines,
    "q_translate_ids": q_translate_ids,
    "q_complete_stage": q_complete_stage,
    "q_rank_stage": q_rank_stage,
    "q_scan_csv": q_scan_csv,
    "q_scan_turtle": q_scan_turtle,
    "q_append_runs": q_append_runs,
    "q_token_cut": q_token_cut,
}
