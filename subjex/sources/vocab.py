"""Vocabulary sources (S3, M8): SKOS label triples to label rows.

Vocabularies arrive as a triples table (s, p, o), as Turtle files (:mod:`subjex.sources.turtle`) or as N-Triples
lines, which a regular expression splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.text import last_path_segment
from subjex.functions.unicode import nfc

# The SKOS label predicates.
PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
ALT_LABEL = "http://www.w3.org/2004/02/skos/core#altLabel"

_NT_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+"((?:[^"\\]|\\.)*)"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?\s*\.\s*$'


def scan_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples with literal objects -> (s, p, o); other lines are skipped."""
    lines = spark.read.text(path)
    x = lines.select(F.regexp_extract("value", _NT_LINE, 1).alias("s"),
                     F.regexp_extract("value", _NT_LINE, 2).alias("p"),
                     F.regexp_extract("value", _NT_LINE, 3).alias("o"))
    return x.where(F.col("s") != "").select("s", "p", _unescape(F.col("o")).alias("o"))


def _unescape(literal: Column) -> Column:
    """The escapes of a literal are those of a JSON string, but for the apostrophe and eight-digit code points."""
    plain = F.regexp_replace(literal, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    plain = F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\U0000", r"$1\\u")
    decoded = F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})
    return F.coalesce(F.get(decoded, F.lit(0)), literal)


def vocab_labels(triples: DataFrame, use_alt: bool = True, phrase: str | None = None) -> DataFrame:
    """S3: (label_id, label_text, is_prefLabel).

    label_id = last ``/`` segment of the subject IRI; prefLabel rows always,
    altLabel rows when ``use_alt``; optional phrase prefix, then NFC (the NFC
    pandas UDF runs once per distinct text only).
    """
    preds = [PREF_LABEL] + ([ALT_LABEL] if use_alt else [])
    t = triples.where(F.col("p").isin(preds))
    text = F.concat(F.lit(phrase), F.col("o")) if phrase else F.col("o")
    return t.where(F.col("o").isNotNull()).select(last_path_segment(F.col("s")).alias("label_id"), nfc(text).alias("label_text"),
                                                  (F.col("p") == PREF_LABEL).alias("is_prefLabel"))


def build_vocab(triples: DataFrame, encode, use_alt: bool = True, phrase: str | None = None,
                batch: int = 32) -> DataFrame:
    """M8: labels + unit-norm embeddings, ready to write (``mode`` overwrite
    or ignore is the writer's choice)."""
    from subjex.operators.infer import embed
    return embed(vocab_labels(triples, use_alt, phrase), "label_text", encode, batch=batch)
