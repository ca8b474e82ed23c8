"""Personal data: base patterns, and transducers that see through disguises and keep offsets.

Method. Base patterns find plain identifiers. Texts with a trace of disguise
also go through a transducer that rewrites look-alike characters, invisible
characters, spelled digits and at/dot disguises into plain characters and
remembers, segment by segment, which source span each output span came from. The
same patterns run over the rewritten text; what they find there with at least
one rewritten segment in it is mapped back to source characters and added.

Every pattern is linear in the text: e-mail local parts are read backwards
from each ``@``, dotted numbers in maximal groups.

Scale. One pass over whole texts, no shuffle, nothing held but one batch.

Defined results. Null text is empty: no spans. Rows that repeat a doc_id are
searched one by one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import small_batches, text_or_empty

#: Fixed by the contract, in its order.
KINDS = ("email", "ip", "card", "phone")
FOUND = "doc_id long, base array<struct<kind: string, start: int, stop: int>>, added array<struct<kind: string, start: int, stop: int>>"

Span = tuple[int, int, int]  # place of the kind in KINDS, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield 1, at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield 2, m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield 3, m.start(), m.end()


_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind and start."""
    found = list(_emails(text))
    return [*found, *_ips(text), *_cards(text), *_phones(text)] if _ANY_DIGIT.search(text) else found


#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(zip("АВЕКМНОРСТХУІЈЅаеорсхуіјѕһԁԛԝӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιανρυ",
                      "ABEKMHOPCTXYIJSaeopcxyijshdqwl" "ABEZHIKMNOPTYXoiavpu"))
#: Characters without width.
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Digits spelled in English, German, French and Spanish.
SPELLED = {w: str(d) for words in ("zero one two three four five six seven eight nine",
                                   "null eins zwei drei vier fünf sechs sieben acht neun",
                                   "zéro un deux trois quatre cinq six sept huit neuf",
                                   "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())}
#: Words and codes for the signs at, dot and plus.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at arroba arobase ät", "dot punkt point punto", "plus más"
#: Endings of host names.
HOST_ENDS = "com org net edu gov info biz io ai app dev co uk de fr es it nl eu us ca au jp ch be se dk pl pt br ru cn mx ar cl me tv xyz example test"
AT_CODES, DOT_CODES = ("&#64;", "&#x40;", "&commat;", "%40"), ("&#46;", "&#x2e;", "&period;", "%2e")


@functools.lru_cache(maxsize=4096)
def plain(char: str) -> str | None:
    """The ASCII character a character passes for, '' for an invisible one, None if it is itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKE:
        return LOOK_ALIKE[char]
    if unicodedata.decimal(char, None) is not None:
        return str(unicodedata.decimal(char))
    same = unicodedata.normalize("NFKC", char)
    if len(same) == 1 and "!" <= same <= "~":
        return same
    return {"。": ".", "․": "."}.get(char)


def _words(words: str) -> str:
    return "|".join(map(re.escape, words.split()))


_DIGIT_WORD = "|".join(sorted(map(re.escape, SPELLED), key=len, reverse=True))
_OPEN, _CLOSE, _RULE = r"[\(\[\{<]", r"[\)\]\}>]", r"[ \t]*[_*|~-]+"
_DOT_SIGN = rf"(?:\s*{_OPEN}\s*(?:{_words(DOT_WORDS)}|\.)\s*{_CLOSE}\s*|[ \t]+(?:{_words(DOT_WORDS)})[ \t]+|{_RULE}(?:{_words(DOT_WORDS)})[_*|~-]+[ \t]*)"
_AT_SIGN = rf"(?:\s*{_OPEN}\s*(?:{_words(AT_WORDS)}|@)\s*{_CLOSE}\s*|{_RULE}(?:{_words(AT_WORDS)})[_*|~-]+[ \t]*)"
#: ``at`` between plain spaces counts only before a host whose last part is a known ending after a dot disguise.
_AT_SPACED = rf"[ \t]+(?:{_words(AT_WORDS)})[ \t]+(?=[A-Za-z0-9-]+(?:(?:{_DOT_SIGN}|\.)[A-Za-z0-9-]+)*?{_DOT_SIGN}(?:{_words(HOST_ENDS)})\b)"
_RUN = rf"\b(?:{_DIGIT_WORD})(?:[\s,.-]+(?:{_DIGIT_WORD}|oh)\b)*\b"
#: One rewriting step at a time, leftmost first.
_STEP = re.compile(rf"(?P<at>(?<=[A-Za-z0-9])(?:{_AT_SIGN}|{_AT_SPACED})(?=[A-Za-z0-9]))|(?P<dot>(?<=[A-Za-z0-9]){_DOT_SIGN}(?=[A-Za-z0-9]))"
                   rf"|(?P<at_code>{'|'.join(AT_CODES)})|(?P<dot_code>{'|'.join(DOT_CODES)})"
                   rf"|(?P<plus>\b(?:{_words(PLUS_WORDS)})\s+(?=(?:{_DIGIT_WORD}|[0-9]+)\b))|(?P<run>{_RUN})"
                   rf"|(?P<o>(?<=[0-9])[Oo](?=[0-9]|\b))|(?P<l>(?<=[0-9])[lI](?=[0-9]|\b))", re.I)
_FIXED = {"at": "@", "dot": ".", "at_code": "@", "dot_code": ".", "plus": "+", "o": "0", "l": "1"}
_WORD = re.compile(rf"{_DIGIT_WORD}|oh", re.I)
_BRACKETED = re.compile(rf"{_OPEN}\s*(?:{_words(AT_WORDS)}|{_words(DOT_WORDS)}|@|\.)\s*{_CLOSE}")
_RULED = re.compile(rf"[_*|~-](?:{_words(AT_WORDS)}|{_words(DOT_WORDS)})[_*|~-]")
_LETTER_DIGIT = re.compile("[0-9][oli]")
#: A digit word can matter only beside another digit (word) or a plus sign; one with a letter beyond ASCII also in a host or local part.
_COUNTED = re.compile(rf"\b(?:{_words(PLUS_WORDS)})\s+(?:{_DIGIT_WORD}|[0-9])|\b(?:{_DIGIT_WORD})\b[\s,.()-]*(?:[0-9]|(?:{_DIGIT_WORD}|oh)\b)|[0-9+][ ().-]*\b(?:{_DIGIT_WORD})\b")
_SPLIT = re.compile(r"\W+")
_NUMBER_WORDS, _DOTS, _ACCENTED = frozenset((*SPELLED, *PLUS_WORDS.split())), frozenset(DOT_WORDS.split()), frozenset(w for w in SPELLED if not w.isascii())


def _disguised(text: str) -> bool:
    """Whether the second transducer can add a span: most texts stop here. True for every text it finds something in."""
    low = text.lower()
    if not text.isascii():
        low = low.replace("i\u0307", "i").replace("\u0131", "i")  # as patterns that ignore case have it
    if any(w in low for w in ("&#", "%40", "%2e", "&commat;", "&period;")) or _RULED.search(low) or _LETTER_DIGIT.search(low):
        return True
    if any(c in low for c in "([{<") and _BRACKETED.search(low):
        return True
    words = set(_SPLIT.split(low))
    return not words.isdisjoint(_DOTS) or not words.isdisjoint(_ACCENTED) or not words.isdisjoint(_NUMBER_WORDS) and bool(_COUNTED.search(low))


class Rewritten:
    """A rewritten text that knows, for every output span, its source span."""

    def __init__(self):
        self.out, self.size = [], 0
        self.starts, self.segments = [], []  # by output start: (output start, source start, source end, rewritten)

    def add(self, text: str, start: int, stop: int, changed: bool) -> None:
        if text:
            self.starts.append(self.size)
            self.segments.append((self.size, start, stop, changed))
            self.out.append(text)
            self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.out)

    def source(self, start: int, stop: int) -> tuple[int, int, bool]:
        """Source span of an output span, and whether rewriting touched it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, stop - 1) - 1
        a, b = self.segments[i], self.segments[j]
        return (a[1] if a[3] else a[1] + start - a[0], b[2] if b[3] else b[1] + stop - b[0],
                any(s[3] for s in self.segments[i:j + 1]) or (i < j and any(x[2] != y[1] for x, y in zip(self.segments[i:j], self.segments[i + 1:j + 1]))))


def _characters(text: str) -> Rewritten | None:
    """First transducer: look-alike and invisible characters; None where there are none."""
    odd = "".join(c for c in set(text) if c > "\x7f" and plain(c) is not None)
    if not odd:
        return None
    r, at = Rewritten(), 0
    for m in re.finditer(f"[{re.escape(odd)}]", text):
        r.add(text[at:m.start()], at, m.start(), False)
        r.add(plain(m[0]), m.start(), m.end(), True)
        at = m.end()
    r.add(text[at:], at, len(text), False)
    return r


def _spoken(text: str) -> Rewritten:
    """Second transducer: at, dot and plus in words or codes, spelled digits, letters for digits."""
    r, at = Rewritten(), 0
    for m in _STEP.finditer(text):
        new = "".join(SPELLED.get(w.lower(), "0") for w in _WORD.findall(m[0])) if m.lastgroup == "run" else _FIXED[m.lastgroup]
        r.add(text[at:m.start()], at, m.start(), False)
        r.add(new, m.start(), m.end(), True)
        at = m.end()
    r.add(text[at:], at, len(text), False)
    return r


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Source spans of identifiers that show only after rewriting."""
    first = None if text.isascii() else _characters(text)
    plain_text = text if first is None else first.text
    second = _spoken(plain_text) if _disguised(plain_text) else None
    if first is None and second is None:
        return []
    found = []
    for kind, start, stop in base_spans(second.text if second else plain_text):
        changed = False
        if second:
            start, stop, changed = second.source(start, stop)
        if first:
            start, stop, touched = first.source(start, stop)
            changed |= touched
        if changed and not any(k == kind and a <= start and stop <= b for k, a, b in base):
            found.append((kind, start, stop))
    return sorted(set(found))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base spans, added spans) of every row."""
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in spans]
        for b in batches:
            base, added = [], []
            for text in b.column("text").to_pylist():
                base.append(base_spans(text))
                added.append(added_spans(text, base[-1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(named, base), span), pa.array(map(named, added), span)], names=["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(search, FOUND)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans merge."""
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if stop > at:
            out += [text[at:max(at, start)]] + ([f"<{kind}>"] if start >= at else [])
            at = stop
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    """``kind:start:end`` by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def digest_rows(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(7)]
            for base, added in zip(b.column("base").to_pylist(), b.column("added").to_pylist()):
                base, added = ([(s["kind"], s["start"], s["stop"]) for s in x] for x in (base, added))
                for i, k in enumerate(KINDS):
                    cols[i].append(sum(s[0] == k for s in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined([*base, *added]))
                cols[6].append(len(added))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return found.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
