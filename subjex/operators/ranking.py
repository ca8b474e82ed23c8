"""Rank stage (F7, J8, V3, F2, P7, W3, A7-A10): relevance questions per
(doc, distinct term), answers parsed to numbers, alphabetical cap,
normalisation by the global maximum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.functions.text import fill_prompt, rank_body, relevance_value


def terms_per_doc(predictions: DataFrame) -> DataFrame:
    """A7 in long form: distinct (doc, term)."""
    return predictions.select("doc_id", "term").where(F.col("term").isNotNull()).distinct()


def collect_terms(predictions: DataFrame) -> DataFrame:
    """A7 as arrays (only when a caller needs one row per document)."""
    return predictions.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def rank_frame(template: dict[str, str], instruction: str, lo: int = 0, hi: int = 10) -> str:
    """the frame of a relevance question: the template's instruction and example parts only (no assistant turn),
    with the rank instruction and its two confidence bounds filled in; ``{text}`` stays open."""
    if "{min_confidence}" not in instruction or "{max_confidence}" not in instruction:
        raise ValueError("the rank instruction needs {min_confidence} and {max_confidence}")
    bounded = instruction.replace("{min_confidence}", str(lo)).replace("{max_confidence}", str(hi))
    return template["instruction"].replace("{custom_instruction}", bounded) + template["example"]


def relevance_prompts(predictions: DataFrame, content: DataFrame, frame: str) -> DataFrame:
    """F7 + J8 + V3: one prompt per (doc, distinct term).

    ``content`` holds (doc_id, content). A document without content fails the
    job in the same pass (V3), as the rank stage refuses to run then.
    """
    t = terms_per_doc(predictions)
    j = t.join(content.select("doc_id", "content"), "doc_id", "left")
    checked = F.when(F.col("content").isNull(),
                     F.raise_error(F.concat(F.lit("empty content for document "),
                                            F.col("doc_id").cast("string")))).otherwise(F.col("content"))
    body = rank_body(checked, F.col("term"))
    return j.select("doc_id", "term", fill_prompt(F.lit(frame), body).alias("prompt"))


def accept(answers: DataFrame, threshold: float = 0.0, max_suggestions: int = 50) -> DataFrame:
    """F2 + P7 + W3: relevance from the answer; keep relevance >= threshold;
    per document the first ``max_suggestions`` accepted terms in alphabetical
    (code point) order. The row_number filter lets Spark cut each group to
    the limit before the shuffle (window group limit)."""
    r = answers.withColumn("relevance", relevance_value(F.col("answer")))
    r = r.where(F.col("relevance") >= threshold)
    w = Window.partitionBy("doc_id").orderBy("term")
    return r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_suggestions).drop("_rn")


def label_for_term(predictions: DataFrame) -> DataFrame:
    """Per (doc, term) the prediction row a dictionary keyed by term keeps:
    the one with the greatest label_id."""
    cols = [c for c in predictions.columns if c not in ("doc_id", "term")]
    row = F.struct(*[F.col(c) for c in cols])
    return predictions.groupBy("doc_id", "term").agg(F.max_by(row, F.col("label_id")).alias("_r")) \
        .select("doc_id", "term", "_r.*")


def normalise_relevance(accepted: DataFrame, predictions: DataFrame,
                        score_param: str = "relevance") -> DataFrame:
    """A8 + A9 + A10: attach each accepted (doc, term) to its label, divide by
    the global maximum (a scalar subquery; all-zero gives 0, trap N5), then
    one row per (doc, label) with the maximum score."""
    lab = label_for_term(predictions)
    j = accepted.select("doc_id", "term", "relevance").join(lab, ["doc_id", "term"], "inner")
    if score_param == "score":
        s = F.col("score")
    else:
        v = F.col(score_param).cast("double")
        mx = j.select(F.max(v)).scalar()
        s = F.coalesce(F.try_divide(v, mx), F.lit(0.0))
    return j.select("doc_id", "label_id", s.alias("score")).groupBy("doc_id", "label_id") \
        .agg(F.max("score").alias("score"))
