"""Prompt construction."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from subjex.functions.text import compose_content, count_pieces, cut_words, fill_prompt, n_words, token_budget

# The ChatML chat template (one of the three shipped templates).
CHATML = {
    "instruction": "<|im_start|>system\n{custom_instruction}<|im_end|>\n",
    "example": "<|im_start|>user\n{text}<|im_end|>\n",
    "keywords": "<|im_start|>assistant\n{keywords}<|im_end|>\n",
    "test_item": "<|im_start|>user\n{text}<|im_end|>\n<|im_start|>assistant\n",
}


def render_examples(examples: DataFrame, template: dict[str, str], instruction: str = "") -> DataFrame:
    """F5 for one template: per prompt, the instruction (only when one is
    given), every example and its keywords in file order, then the test item
    with its ``{text}`` slot left open. ``examples``: (prompt, ord, text, keywords)."""
    piece = F.concat(F.replace(F.lit(template["example"]), F.lit("{text}"), F.col("text")),
                     F.replace(F.lit(template["keywords"]), F.lit("{keywords}"), F.col("keywords")))
    body = examples.groupBy("prompt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))),
                                 lambda x: x["p"]), "").alias("_body"))
    head = template["instruction"].replace("{custom_instruction}", instruction) if instruction else ""
    return body.select("prompt", F.concat(F.lit(head), F.col("_body"), F.lit(template["test_item"])).alias("frame"))


def prompt_frames(runs: DataFrame, model_templates: DataFrame, templates: DataFrame,
                  examples: DataFrame, instruction: str = "") -> DataFrame:
    """J15 + F5: one frame per run (model, prompt), the model's template
    chosen by key. ``runs`` is the caller's run matrix; templates and the
    model map are small dimension tables (broadcast)."""
    t = F.broadcast(model_templates.join(templates.withColumnRenamed("name", "template"), "template"))
    r = runs.join(t, "model", "inner")
    piece = F.concat(F.replace(F.col("example"), F.lit("{text}"), F.col("text")),
                     F.replace(F.col("keywords"), F.lit("{keywords}"), F.col("kw")))
    ex = examples.withColumnRenamed("keywords", "kw")
    j = r.join(ex, "prompt", "inner")
    body = j.groupBy("model", "prompt").agg(
        F.first("instruction").alias("instruction"), F.first("test_item").alias("test_item"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))),
                                 lambda x: x["p"]), "").alias("_body"))
    head = F.replace(F.col("instruction"), F.lit("{custom_instruction}"), F.lit(instruction)) \
        if instruction else F.lit("")
    return body.select("model", "prompt", F.concat(head, F.col("_body"), F.col("test_item")).alias("frame"))


def fill(docs: DataFrame, frames: DataFrame, model: str, prompt: str,
         budget_words: int | None = None, max_total: int | None = None, max_new: int = 100) -> DataFrame:
    """F6 + F8 for one run: every document put into the run's frame (a
    scalar subquery; frames hold one row per run), cut to the word budget
    when one is given: ``budget_words`` itself, or what ``max_total`` leaves
    beside the answer (``max_new``) and the frame. Texts within the budget
    stay as they are."""
    frame = frames.where((F.col("model") == model) & (F.col("prompt") == prompt)).select("frame").scalar()
    budget = budget_words
    if budget is None and max_total is not None:
        budget = token_budget(max_total, max_new, n_words(F.replace(frame, F.lit("{text}"), F.lit(""))))
    content = cut_words(F.col("content"), budget) if budget is not None else F.col("content")
    return docs.select(F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), "doc_id",
                       fill_prompt(frame, content).alias("text"))


def fill_runs(docs: DataFrame, frames: DataFrame, max_total: int | None = None, max_new: int = 100, place: str | None = None) -> DataFrame:
    """F6 + F8 + J15 for all runs at once: every document (doc_id, content, any other columns) in the frame of every run (model, prompt, frame),
    cut to the words that ``max_total`` leaves beside the answer and the frame. The run table has a row per run, a parameter
    of the stage; each document is read once and leaves once per run. ``place`` names a column for the number of the run, which
    is the same in every call with the same runs."""
    # one array of all frames, as a scalar: no pairing of two tables
    runs = frames.select(F.array_sort(F.collect_list(F.struct("model", "prompt", "frame", n_words(F.replace("frame", F.lit("{text}"), F.lit(""))).alias("n"))))).scalar()
    kept = [c for c in docs.columns if c != "content"]
    content, words = F.col("content"), []
    if max_total is not None:
        words = [count_pieces(content).alias("_words")]  # counted once per document, not once per run
        content = cut_words(content, token_budget(max_total, max_new, F.col("r.n")), F.col("_words"))
    each = docs.select(*docs.columns, *words).select("*", F.posexplode(runs).alias("_run", "r"))
    return each.select("r.model", "r.prompt", *kept, fill_prompt(F.col("r.frame"), content).alias("text"), *([F.col("_run").alias(place)] if place else []))


#: Characters that are encoded at a time for each token of the budget.
CHARS_PER_TOKEN = 12


def _cut_at_token(tokenizer, text: str, budget: int) -> tuple[str, int]:
    """The longest start of ``text`` that ends at a token and takes ``budget`` tokens at most, and its tokens."""
    def encode(t):
        return tokenizer.encode(t, add_special_tokens=False)
    if budget <= 0:
        return "", 0
    size = max(64, budget * CHARS_PER_TOKEN)
    while True:  # long texts are encoded no further than the budget reaches
        e = encode(text[:size])
        # what stands at the end of a piece may go on beyond it: only a piece with tokens to spare decides
        if size >= len(text) or len(e.ids) > budget + 8:
            break
        size *= 2
    if len(e.ids) <= budget:
        return text, len(e.ids)
    for n in range(budget, 0, -1):
        cut = text[:e.offsets[n - 1][1]]
        again = len(encode(cut).ids)
        if again <= budget:
            return cut, again
    return "", 0


def cut_to_tokens(df: DataFrame, tokenizer: str, budget: int | Column, text_col: str = "content") -> DataFrame:
    """F8 with a caller's tokenizer (the path of a tokenizers file): ``text_col`` cut after its last whole token within
    ``budget`` (a number or a column), with ``n_tokens``, the tokens that the cut text takes when it is encoded again.

    The tokenizer is loaded once per worker; a null text stays null with 0 tokens."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("n_tokens", IntegerType(), True)])

    def run(batches):
        tok = _tokenizer(tokenizer)
        for b in batches:
            cut = [(None, 0) if t is None else _cut_at_token(tok, t, n) for t, n in zip(b.column(text_col).to_pylist(), b.column("_budget").to_pylist())]
            cols = [pa.array([x[0] for x in cut], pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[1] for x in cut], pa.int32())], names=[*names, "n_tokens"])
    return df.withColumn("_budget", budget.cast("int")).mapInArrow(run, schema)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def sample_examples(dataset: DataFrame, which: str, n: int, seed: int = 0) -> DataFrame:
    """T4: n seeded examples; text = title / abstract / both (joined by a
    space; NULL if a needed part is NULL), keywords = labels joined by ``", "``."""
    text = compose_content(F.col("title"), F.col("abstract"), which)
    picked = dataset.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(n)
    return picked.select("doc_id", text.alias("text"), F.array_join("labels", ", ").alias("keywords"))
