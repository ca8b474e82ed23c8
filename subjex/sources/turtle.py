"""Turtle vocabularies (S3): statements found in parallel, each parsed in its task.

Files are cut into statements by :mod:`subjex.sources.split_lines`: a statement ends with a line that
ends in a full stop outside literals, IRIs and comments. A line's effect depends on the state
it begins in: between statements, inside one, or inside one of the two kinds of long literals.
A statement sees the prefixes and bases declared before it in its file: every split says which ones it
declares, these are composed along each file, a row per split, and a split reads its records in order from there.
A file may declare as often as it has statements; what a task holds is one IRI per distinct prefix.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.sources.split_lines import _runs, read_lines, records

#: Between statements, inside one, inside a long literal in double quotes, in single quotes.
BETWEEN, INSIDE, DOUBLE, SINGLE = range(4)

# Fixed value: the namespace of the RDF terms that the syntax stands for.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_OUTSIDE = re.compile(r"""(?P<skip>[^\S\n]+|\#.*)|(?P<long>\"{3}|'{3})|(?P<whole><[^<>"{}|^`\s]*>|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<char>[^\s#"'<]+|.)""")
_CLOSE = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""'), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''")}


def _after_line(line: str, state: int) -> int:
    at, last = 0, ""
    if state in _CLOSE:
        m = _CLOSE[state].match(line)
        if not m:
            return state
        at, state, last = m.end(), INSIDE, '"'
    while at < len(line):
        m = _OUTSIDE.match(line, at)
        at = m.end()
        if m.lastgroup == "long":
            kind = DOUBLE if m.group() == '"""' else SINGLE
            closed = _CLOSE[kind].match(line, at)
            if not closed:
                return kind
            at, last = closed.end(), '"'
        elif m.lastgroup != "skip":
            last = m.group()[-1]
    if not last:
        return state
    return BETWEEN if last == "." else INSIDE


def _pass(lines: list[str], state: int) -> int:
    for line in lines:
        state = _after_line(line, state)
    return state


def _ends(lines: list[str], state: int) -> tuple[np.ndarray, int]:
    out = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        # as if inside a statement: only a full stop at the end leads out of it, blank lines and comments do not
        out[i] = _after_line(line, INSIDE if state == BETWEEN else state) == BETWEEN
        state = _after_line(line, state)
    return out, state


_TOKEN = re.compile(r"""
  (?P<skip>\s+|\#[^\n]*)
| (?P<iri><[^<>"{}|^`\x00-\x20]*>)
| (?P<literal>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
| (?P<tag>\^\^|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
| (?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+\.\d+|\d+)(?![\w:]))
| (?P<blank>_:[\w](?:[\w\-\u00B7]|\.(?=[\w.\-\u00B7]*[\w\-\u00B7]))*)
| (?P<name>(?:[^\W\d_](?:[\w\-\u00B7]|\.(?=[\w.\-\u00B7]*[\w\-\u00B7]))*)?:(?:[\w:\-\u00B7]|%[0-9A-Fa-f]{2}|\\.|\.(?=[.]*[\w:%\\\-\u00B7]))*)
| (?P<word>[A-Za-z]+)
| (?P<mark>[.;,\[\]()])""", re.VERBOSE | re.DOTALL)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)) if m.group(1) or m.group(2) else _ESCAPED.get(m.group(3), m.group(3)), text)


_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")


def _resolved(base: str | None, iri: str) -> str:
    """An IRI with a scheme stands for itself, any other is relative to the base; an empty fragment stays."""
    if base is None or _ABSOLUTE.match(iri):
        return iri
    joined = urljoin(base, iri)
    return joined + "#" if iri.endswith("#") and not joined.endswith("#") else joined


class _Statements:
    """Triples of the statements of one record, in order; declarations take effect as they come, in ``declared`` too."""

    def __init__(self, text: str, declared: dict[str, str], name: str):
        self.tokens, self.at, self.made, self.name, self.prefixes, self.out = [], 0, 0, name, declared, []
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise ValueError(f"not Turtle: {text[place:place + 40]!r}")
            place = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or wanted is not None and t[1] != wanted:
            raise ValueError(f"not Turtle: {wanted or 'a term'} expected, {t[1]!r} found")
        self.at += 1
        return t

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            return _resolved(self.prefixes.get("@base"), _unescaped(text[1:-1]))
        prefix, local = text.split(":", 1)
        if prefix not in self.prefixes:
            raise ValueError(f"prefix {prefix!r} is not declared")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.name}-{self.made}"

    def declarations(self) -> list[tuple[str, str]]:
        """(prefix or @base, IRI as it is written) of the record's declarations, in order."""
        found = []
        while self.peek()[0] != "end":
            kind, text = self.take()
            if text.lower() in ("@prefix", "@base", "prefix", "base") and kind in ("tag", "word"):
                key = self.take()[1][:-1] if "prefix" in text.lower() else "@base"
                of, iri = self.take()
                if of != "iri":
                    raise ValueError(f"not Turtle: an IRI expected, {iri!r} found")
                found.append((key, _unescaped(iri[1:-1])))
                if kind == "tag":
                    self.take(".")
                continue
            while (kind, text) != ("mark", "."):
                kind, text = self.take()
        return found

    def run(self) -> list[tuple[str, str, str, bool]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            lower = text.lower()
            if lower in ("@prefix", "@base", "prefix", "base") and kind in ("tag", "word"):
                self.take()
                key = self.take()[1][:-1] if "prefix" in lower else "@base"
                self.prefixes[key] = self.iri(*self.take())
                if kind == "tag":
                    self.take(".")
                continue
            listed = text == "["
            subject = self.term()[0]
            if not (listed and self.peek()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.out

    def predicates(self, subject: str) -> None:
        """Predicate and object lists; a semicolon may repeat and may end the list."""
        while self.peek()[1] not in (".", "]"):
            kind, text = self.take()
            predicate = RDF + "type" if (kind, text) == ("word", "a") else self.iri(kind, text)
            more = True
            while more:
                value, literal = self.term()
                self.out.append((subject, predicate, value, literal))
                more = self.peek()[1] == ","
                if more:
                    self.take(",")
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take(";")

    def term(self) -> tuple[str, bool]:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, text), False
        if kind == "blank":
            return f"_:{self.name.rsplit('-', 2)[0]}-{text[2:]}", False
        if kind == "literal":
            quote = 3 if text[:3] in ('"""', "'''") and len(text) >= 6 else 1
            if self.peek()[0] == "tag":
                if self.take()[1] == "^^":
                    self.iri(*self.take())
            return _unescaped(text[quote:-quote]), True
        if kind == "number" or (kind == "word" and text in ("true", "false")):
            return text, True
        if text == "[":
            own = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(own)
            self.take("]")
            return own, False
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            rest = RDF + "nil"
            for value, literal in reversed(items):
                own = self.fresh()
                self.out += [(own, RDF + "first", value, literal), (own, RDF + "rest", rest, False)]
                rest = own
            return rest, False
        raise ValueError(f"not Turtle: {text!r}")


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split declares last, per prefix: the relative IRIs that lead to it from the base before the split."""
    key, chains = None, {}

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([list(chains)], pa.list_(pa.string())),
                                           pa.array([list(chains.values())], pa.list_(pa.list_(pa.string())))], names=["file", "start", "keys", "chains"])
    for own, begins, b in _runs(batches):
        if begins:
            if key is not None:
                yield row()
            key, chains = own, {}
        for text in b.column("text").to_pylist():
            for name, iri in _Statements(text, {}, "").declarations():
                base = chains.get("@base", [])
                known = base and _ABSOLUTE.match(base[0])  # else relative to what comes before the split
                chains[name] = [iri] if _ABSOLUTE.match(iri) else [_resolved(base[0], iri)] if known else [*base, iri]
    if key is not None:
        yield row()


def _before_splits(pdf: pd.DataFrame) -> pd.DataFrame:
    """The splits of one file with the prefixes declared before each."""
    known, rows = {}, []
    for r in pdf.sort_values("start").itertuples():
        rows.append((r.file, r.start, list(known), list(known.values())))
        if r.keys is not None:
            base, new = known.get("@base"), {}
            for name, chain in zip(r.keys, r.chains):
                iri = base
                for x in chain:
                    iri = _resolved(iri, x)
                new[name] = iri
            known.update(new)
    return pd.DataFrame(rows, columns=["file", "start", "keys", "iris"])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples of the records of whole splits, in order; a split begins with the row of what is declared before it."""
    declared: dict[str, str] = {}
    for (file, start), begins, b in _runs(batches):
        if begins:
            declared = {}
        out = []
        for r in b.select(["line", "text", "keys", "iris"]).to_pylist():
            if r["text"] is None:
                declared = dict(zip(r["keys"], r["iris"]))
            else:
                out += _Statements(r["text"], declared, f"{zlib.crc32(file.encode())}-{start}-{r['line']}").run()
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=["s", "p", "o", "is_literal"])


def scan_turtle(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Turtle (and N-Triples) files -> (s, p, o, is_literal): every triple; a malformed statement fails the job.

    Blank nodes are named by file, so equal labels of two files stay apart."""
    from subjex.session import cut_lineage
    lines = read_lines(spark, paths)
    found = cut_lineage(records(lines, 4, _pass, _ends).select("file", "start", "line", "text"))  # declarations and triples read it
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # parsing costs more than its bytes
    in_order = lambda df: df.repartition(tasks, "file", "start").sortWithinPartitions("file", "start", "line")
    heads = in_order(found.where(F.lower("text").rlike(r"(^|[\s.])(@?prefix|@?base)\s")))
    changes = heads.mapInArrow(_changes, "file string, start long, keys array<string>, chains array<array<string>>")
    splits = lines.select("file", "start").distinct().join(changes, ["file", "start"], "left")
    before = splits.groupBy("file").applyInPandas(_before_splits, "file string, start long, keys array<string>, iris array<string>")  # a row per split of a file
    first = before.select("file", "start", F.lit(-1).cast("long").alias("line"), F.lit(None).cast("string").alias("text"), "keys", "iris")
    none = F.lit(None).cast("array<string>")
    return in_order(first.unionByName(found.select("*", none.alias("keys"), none.alias("iris")))).mapInArrow(_triples, "s string, p string, o string, is_literal boolean")
