"""End-to-end stage compositions (the reference's stages as Spark plans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.scores import stable_round
from subjex.operators import ensemble as E
from subjex.operators import evaluate as V
from subjex.plans import fixtures as X


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fixed ensemble voted, cut at its best-F1 cell and scored by
    strata, in one plan keyed by ``ensemble``."""
    votes = E.vote(X.pred(spark, sf_dir), X.members(spark, sf_dir)) \
        .select("ensemble", "doc_id", "label_id", stable_round(F.col("score"), 9).alias("score"))
    res = V.evaluate(X.gold(spark, sf_dir), votes, by=["ensemble"], steps=100)
    return res["metrics"].join(res["auc"], "ensemble", "left")


def map_stage(completions: DataFrame, vocab: DataFrame, search: str = "vector", alpha: float = 0.7,
              min_cosine: float = 0.7, id_table: DataFrame | None = None,
              allowed: DataFrame | None = None, score_param: str = "hybrid_score",
              encode=None, by=("model", "prompt"), phrase: str | None = None, n_probe: int | None = None,
              debug_rows: int | None = None):
    """M9: completions -> (predictions, removed, stats), one plan.

    A2 count rows -> A3 distinct keywords -> embed once per keyword (M5) ->
    nearest label (M1, or approximate by clusters, M4) or hybrid (M2) -> J3 attach -> P3 threshold ->
    J4/P4 ids -> J5 allow-list -> A4 best match -> P5 score -> A15 stats.
    ``vocab``: (label_id, label_text, embedding). ``phrase`` (F14) is put
    before every keyword before it is embedded, as the vocabulary labels may
    carry it (``vocab_labels(phrase=...)``). ``debug_rows`` (P13) limits the
    completions for a quick look. ``search="clusters"`` cuts the vocabulary
    into about the square root of its size of clusters and probes ``n_probe``,
    or as many as a sample of the keywords needs for a recall of 0.95. With ``id_table`` the stats count the unmapped
    matches of each run.
    """
    from subjex.operators import mapping as M
    from subjex.operators.bm25 import hybrid
    from subjex.operators.infer import embed
    from subjex.operators.knn import nearest, nearest_clusters

    if debug_rows:
        completions = completions.limit(debug_rows)
    rows = M.count_rows(completions)
    from subjex.session import cut_lineage
    # a model call costs more than its keyword's bytes tell, by which tasks would be merged
    cands = M.distinct_candidates(completions).repartition(2 * completions.sparkSession.sparkContext.defaultParallelism)
    # the model runs once per distinct keyword; the result is checkpointed so
    # that sizing and search read it instead of calling the model again
    text = cands.withColumn("_q", F.concat(F.lit(phrase), F.col("candidate")) if phrase else F.col("candidate"))
    q = cut_lineage(embed(text, "_q", encode=encode).select(
        F.monotonically_increasing_id().alias("query_id"), "candidate", "embedding"))  # read from the checkpoint only
    if search in ("vector", "clusters"):
        queries = q.select("query_id", "embedding")
        if search == "vector":
            near = nearest(queries, vocab, k=1)
        else:
            n_clusters = max(1, round(vocab.count() ** 0.5))
            near = nearest_clusters(queries, vocab, k=1, n_clusters=n_clusters, n_probe=n_probe)
        found = near.select(
            "query_id", "label_id", F.col("label_text").alias("term"),
            F.col("cosine").alias("cosine_similarity"), F.lit(None).cast("double").alias("hybrid_score"))
    elif search == "hybrid":
        found = hybrid(q.select("query_id", "embedding", F.col("candidate").alias("query")), vocab,
                       alpha=alpha).select("query_id", "label_id", "term",
                                           F.col("cosine").alias("cosine_similarity"), "hybrid_score")
    else:
        raise ValueError("search must be 'vector', 'clusters' or 'hybrid'")
    matches = cut_lineage(q.select("query_id", "candidate").join(found, "query_id").drop("query_id"))  # three outputs read it
    attached = M.attach_matches(rows, matches)
    kept, removed = M.split_threshold(attached, min_cosine)
    if id_table is not None:
        kept, unmapped = M.translate_ids(kept, id_table)
    else:
        kept = M.prefix_ids(kept)
    allowed_rows = M.allow(kept, allowed) if allowed is not None else kept
    best = M.select_score(M.best_match(allowed_rows, by=list(by)), score_param)
    stats = M.map_stats(best, removed, kept if allowed is not None else None,
                        allowed_rows if allowed is not None else None, by=list(by))
    if id_table is not None:
        lost = unmapped.groupBy(*by).agg(F.count(F.lit(1)).alias("n_unmapped_ids"))
        stats = stats.join(lost, list(by), "full_outer").fillna(0, ["n_unmapped_ids"])
    return best, removed, stats


def without_content(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents that ``complete_stage`` has no content for, to be counted or kept."""
    from subjex.functions.text import compose_content
    return docs.where(compose_content(F.col("title"), F.col("abstract")).isNull()).select("doc_id")


def complete_stage(docs: DataFrame, frames: DataFrame, model: str, prompt: str, generate_fn,
                   budget_words: int | None = None, batch: int = 20, max_total: int | None = None, max_new: int = 100) -> DataFrame:
    """The complete stage for one run: content (P2) -> fill (F6/F8) ->
    generate (M6) -> parse (F1) -> completions rows. A document without any
    content has nothing to ask about; ``without_content`` returns those."""
    from subjex.functions.text import compose_content
    from subjex.operators.infer import completions, generate
    from subjex.operators.prompts import fill
    content = docs.select("doc_id", compose_content(F.col("title"), F.col("abstract")).alias("content"))
    prompts = fill(content.where(F.col("content").isNotNull()), frames, model, prompt, budget_words, max_total, max_new)
    answers = generate(prompts, "text", generate_fn, batch=batch)
    return completions(answers.select("model", "prompt", "doc_id", "answer"))


def complete_runs(docs: DataFrame, frames: DataFrame, store: str, generate_fn, batch: int = 20, max_total: int | None = None, max_new: int = 100,
                  parts: int = 8) -> DataFrame:
    """The complete stage over all runs (model, prompt, frame): content, fill, ask what the answer store does not
    hold yet, parse. A restart asks nothing twice; more runs or documents ask only what is new. The prompts of all runs
    are made where they are asked; what is written and moved is each document's content and a key per prompt."""
    from subjex.functions.text import compose_content
    from subjex.operators.infer import ask, completions
    from subjex.operators.prompts import fill_runs
    from subjex.session import cut_lineage
    frames = cut_lineage(frames)  # a row per run
    content = docs.select("doc_id", compose_content(F.col("title"), F.col("abstract")).alias("content"))
    return completions(ask(content.where(F.col("content").isNotNull()), store, generate_fn, batch=batch, parts=parts,
                           expand=lambda rows: fill_runs(rows, frames, max_total, max_new, place="_place")))


def rank_stage(ensemble: DataFrame, docs: DataFrame, frame: str, generate_fn, threshold: float = 0.0,
               max_suggestions: int = 50, score_param: str = "relevance", batch: int = 20, store: str | None = None, model: str = "rank") -> DataFrame:
    """The rank stage: one relevance question per (doc, distinct term)
    (F7/J8/V3), model answers (M7), parse (F2), accept (P7/W3), normalise
    (A8-A10) -> ranked (doc_id, label_id, score). ``frame`` comes from :func:`ranking.rank_frame`; with a
    ``store`` answers given before are not asked for again."""
    from subjex.functions.text import compose_content
    from subjex.operators import ranking as RK
    from subjex.session import cut_lineage
    from subjex.operators.infer import generate
    content = docs.select("doc_id", compose_content(F.col("title"), F.col("abstract")).alias("content"))
    prompts = RK.relevance_prompts(ensemble, content, frame)
    # read several times below: checkpointed so that the model is asked once
    if store:
        from subjex.operators.infer import ask
        asked = ask(prompts.withColumn("model", F.lit(model)), store, generate_fn, prompt_col="prompt", batch=batch)
    else:
        asked = generate(prompts, "prompt", generate_fn, batch=batch)
    answers = cut_lineage(asked.select("doc_id", "term", "answer"))
    accepted = RK.accept(answers, threshold, max_suggestions)
    return RK.normalise_relevance(accepted, ensemble, score_param)
