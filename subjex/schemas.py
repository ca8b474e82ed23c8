"""Schemas of the stage tables."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructField, StructType)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, D, L, B, I = StringType(), DoubleType(), LongType(), BooleanType(), IntegerType()

DATASET = _s(("language", S), ("split", S), ("text_type", S), ("subjects", S), ("doc_id", S),
             ("title", S), ("abstract", S), ("dcterms:subject", ArrayType(S)), ("labels", ArrayType(S)))
DATASET_CSV = _s(("language", S), ("split", S), ("text_type", S), ("subjects", S), ("doc_id", S),
                 ("title", S), ("abstract", S), ("dcterms:subject", S), ("labels", S))
TRIPLES = _s(("s", S), ("p", S), ("o", S))
VOCAB = _s(("label_id", S), ("label_text", S), ("is_prefLabel", B), ("embedding", ArrayType(FloatType())))
EXAMPLES = _s(("prompt", S), ("ord", I), ("text", S), ("keywords", S))
TEMPLATE = _s(("name", S), ("instruction", S), ("example", S), ("keywords", S), ("test_item", S))
RESPONSES = _s(("model", S), ("prompt", S), ("doc_id", S), ("answer", S))
COMPLETIONS = _s(("model", S), ("prompt", S), ("doc_id", S), ("candidate", S))
PREDICTIONS = _s(("model", S), ("prompt", S), ("doc_id", S), ("label_id", S), ("candidate", S), ("term", S),
                 ("cosine_similarity", D), ("hybrid_score", D), ("score", D))
PREDICTIONS_CSV = _s(("doc_id", S), ("label_id", S), ("candidate", S), ("term", S),
                     ("cosine_similarity", D), ("hybrid_score", D), ("score", D))
MAPPING_STATS = _s(("n_keywords", L), ("n_matches_below_threshold", L), ("n_not_in_allowed_subjects", L))
MEMBERS = _s(("ensemble", S), ("model", S), ("prompt", S), ("ord", I))
ENSEMBLE = _s(("ensemble", S), ("doc_id", S), ("label_id", S), ("score", D), ("term", S),
              ("hybrid_score", D), ("cosine_similarity", D), ("count", L))
RANKED = _s(("doc_id", S), ("label_id", S), ("score", D))
GOLD = _s(("doc_id", S), ("label_id", S), ("language", S), ("text_type", S))
METRICS = _s(("metric", S), ("value", D), ("language", S), ("text_type", S))
PR_CURVE = _s(("recall", D), ("precision", D))
CHAIN = _s(("model_prompt", S), ("cum_score", D))
ID_LIST = _s(("idn", S))
