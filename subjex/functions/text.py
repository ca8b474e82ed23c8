"""Column functions for text: answer parsing, relevance parsing, content, prompts.

All are built-in expressions (JVM side, whole-stage codegen); nothing here
calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware strip: Python's str.strip() removes every white-space code
# point, Spark's trim only the ASCII space (trap N7).
_WS_EDGES = r"(?U)^\s+|\s+$"
# Word tokens for the token budget are separated by ASCII white space.
_WORD_SEP = r"[ \t\n\r\f]+"
_WORD_EDGES = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, _WS_EDGES, "")


def answer_keywords(answer: Column) -> Column:
    """keywords from a model answer, as a distinct array.

    Text before the first newline, then before the first ``<``, split on
    ``", "``, each piece stripped, pieces of length <= 1 dropped, distinct.
    """
    head = F.split(answer, "\n", 2).getItem(0)
    head = F.split(head, "<", 2).getItem(0)
    parts = F.transform(F.split(head, ", ", -1), ustrip)
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 1))


def relevance_value(answer: Column) -> Column:
    """every ASCII digit of the answer concatenated, no digit -> 0.

    ``"8/10"`` becomes 810 on purpose: that is what the reference computes.
    """
    digits = F.regexp_replace(F.coalesce(answer, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", F.lit(0.0)).otherwise(digits.cast("double"))


def safe_int(c: Column) -> Column:
    """integer or 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def str2bool(c: Column) -> Column:
    """t/true/y/yes/1 -> true, f/false/n/no/0 -> false, else NULL."""
    return F.lower(ustrip(c)).try_cast("boolean")


def compose_content(title: Column, abstract: Column, which: str = "both") -> Column:
    """Content of a record; NULL if a needed part is NULL (trap N2)."""
    if which == "both":
        return F.concat(title, F.lit(" "), abstract)
    if which == "title":
        return title
    if which == "abstract":
        return abstract
    raise ValueError(f"which must be one of both/title/abstract, not {which!r}")


def _pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _WORD_EDGES, ""), _WORD_SEP, -1)


def count_pieces(text: Column) -> Column:
    """Number of pieces that ``cut_words`` compares with its budget (1 for an empty text)."""
    return F.size(_pieces(text))


def cut_words(text: Column, budget: Column | int, pieces: Column | None = None) -> Column:
    """F8 with white-space word tokens: keep the first ``budget`` words; a text within the budget stays as it is.

    The whole text is tokenised; the budget (prompt budget minus prompt
    length) decides how much of it goes into the prompt. ``pieces`` is its
    ``count_pieces`` where that was counted before.
    """
    b = F.lit(budget) if isinstance(budget, int) else budget
    words = _pieces(text)
    return F.when((F.size(words) if pieces is None else pieces) <= b, text).otherwise(F.array_join(F.slice(words, 1, F.greatest(b, F.lit(0))), " "))


def n_words(text: Column) -> Column:
    """Number of white-space word tokens; 0 for an empty text."""
    trimmed = F.regexp_replace(text, _WORD_EDGES, "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, _WORD_SEP, -1)))


def token_budget(max_total: int, max_new: int, prompt_len: Column) -> Column:
    """F8 budget: total context minus answer tokens minus prompt tokens."""
    return F.lit(max_total - max_new) - prompt_len


def fill_prompt(frame: Column, text: Column) -> Column:
    """put the document into the prompt frame's ``{text}`` slot.

    A literal replace, so braces inside documents or examples are harmless.
    """
    return F.replace(frame, F.lit("{text}"), text)


def rank_body(text: Column, term: Column) -> Column:
    """F7 body of one relevance question."""
    return F.concat(F.lit("Text: "), text, F.lit("\nSchlagwort:"), term)


def fill_confidence(instruction: Column, lo: int, hi: int) -> Column:
    """the rank instruction with its two confidence slots filled."""
    s = F.replace(instruction, F.lit("{min_confidence}"), F.lit(str(lo)))
    return F.replace(s, F.lit("{max_confidence}"), F.lit(str(hi)))


def last_path_segment(c: Column) -> Column:
    """the text after the last ``/``."""
    return F.element_at(F.split(c, "/", -1), -1)


def gnd_id(c: Column) -> Column:
    """The ``gnd:`` prefix."""
    return F.concat(F.lit("gnd:"), c.cast("string"))


def split_arg(value: str) -> list[str]:
    """command-line lists are written with ``-`` between items."""
    return [v for v in value.split("-") if v]
