"""Chat formatting with typed content parts.

Method. A visitor flattens each turn's parts (text, image, audio, document)
in order into one string: text is escaped, an attachment becomes a numbered
placeholder, its reference and its expanded token count are recorded. Turns
are wrapped in the template's marks. Control strings inside texts are escaped
by a mark that can be taken out again, so marks in the output are always the
template's own and parsing the output gives back every turn.

Scale. A turn is formatted by itself, then rows are dealt by conversation,
sorted inside the task and streamed: a task holds one conversation at a time.
A conversation is one output row, so its size is bounded by the row format,
not by the number of conversations.

Defined results. Null text is empty, a null role is the empty role, a null
turn sorts first, rows that repeat a turn are ordered by role and text, an
unknown part type is kept as a placeholder of kind ``other``. Null counts of
a part count as zero. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import shared_path, small_batches

#: The marks of the template. Fixed values; none overlaps itself or contains ESCAPE.
BEGIN, SYSTEM, END_SYSTEM, USER, END_USER, END_ANSWER, OTHER, END_OTHER = "<s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "</s>", "[ROLE:", "[/ROLE]"
ATTACHMENT = {"image": "[IMAGE:", "audio": "[AUDIO:", "document": "[DOCUMENT:", "other": "[OTHER:"}
CONTROL = [BEGIN, SYSTEM, END_SYSTEM, USER, END_USER, END_ANSWER, OTHER, END_OTHER, *ATTACHMENT.values()]
ESCAPE = "␛"

_TO_ESCAPE = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROL])))
_ESCAPED = re.compile("|".join([ESCAPE * 2, *(re.escape(c[0] + ESCAPE + c[1:]) for c in CONTROL)]))

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHED = "array<struct<turn: int, kind: string, number: int, ref: string, tokens: long>>"
OUT = f"conv_id long, formatted string, loss_spans array<struct<start: long, stop: long>>, attachments {ATTACHED}, expanded_tokens long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: m[0] * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[0] == ESCAPE * 2 else m[0][0] + m[0][2:], text)


@dataclass(frozen=True)
class Expansion:
    """Tokens an attachment expands to: square image patches, audio frames, document pages."""
    patch: int = 14
    tokens_per_second: float = 25.0
    tokens_per_page: int = 256


@dataclass
class Visitor:
    """Flattens the parts of one conversation, numbering attachments across its turns."""
    rates: Expansion
    attachments: list[dict] = field(default_factory=list)

    def flatten(self, turn: int, parts: list[dict]) -> str:
        return "".join(getattr(self, f"visit_{p['type']}", self.visit_other)(turn, p) for p in parts)

    def visit_text(self, turn, part):
        return escape(part.get("text") or "")

    def visit_image(self, turn, part):
        side = lambda n: math.ceil((n or 0) / self.rates.patch)
        return self._place(turn, "image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, turn, part):
        return self._place(turn, "audio", part, math.ceil((part.get("seconds") or 0) * self.rates.tokens_per_second))

    def visit_document(self, turn, part):
        return self._place(turn, "document", part, (part.get("pages") or 0) * self.rates.tokens_per_page)

    def visit_other(self, turn, part):
        return self._place(turn, "other", part, 0)

    def _place(self, turn, kind, part, tokens):
        self.attachments.append({"turn": turn, "kind": kind, "number": len(self.attachments), "ref": part.get("ref"), "tokens": tokens})
        return f"{ATTACHMENT[kind]}{len(self.attachments) - 1}]"


class Conversation:
    """Builds one formatted conversation turn by turn."""

    def __init__(self, conv_id, rates: Expansion):
        self.conv_id, self.visitor = conv_id, Visitor(rates)
        self.out, self.at, self.spans, self.turns = [], 0, [], 0
        self._add(BEGIN)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def add(self, role: str, parts: list[dict]) -> None:
        body = self.visitor.flatten(self.turns, parts)
        self.turns += 1
        if role == "assistant":
            self._add(" ")
            self.spans.append({"start": self.at, "stop": self.at + len(body)})
            self._add(body)
            self._add(END_ANSWER)
        elif role in ("system", "user"):
            self._add(f"{SYSTEM if role == 'system' else USER} {body} {END_SYSTEM if role == 'system' else END_USER}")
        else:
            self._add(f"{OTHER}{len(role)}:{role}] {body} {END_OTHER}")

    def row(self) -> dict:
        found = self.visitor.attachments
        return {"conv_id": self.conv_id, "formatted": "".join(self.out), "loss_spans": self.spans, "attachments": found,
                "expanded_tokens": sum(a["tokens"] for a in found)}


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; attachments stay as their placeholders."""
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        if formatted.startswith(" ", at):
            role, begin, mark = "assistant", at + 1, END_ANSWER
        elif formatted.startswith(OTHER, at):
            colon = formatted.index(":", at + len(OTHER))
            size = int(formatted[at + len(OTHER):colon])
            role, begin, mark = formatted[colon + 1:colon + 1 + size], colon + size + 3, " " + END_OTHER
        elif formatted.startswith(SYSTEM, at):
            role, begin, mark = "system", at + len(SYSTEM) + 1, " " + END_SYSTEM
        else:
            role, begin, mark = "user", at + len(USER) + 1, " " + END_USER
        stop = formatted.index(mark, begin)
        turns.append((role, unescape(formatted[begin:stop])))
        at = stop + len(mark)
    return turns


def format_conversations(turns: DataFrame, rates: Expansion = Expansion()) -> DataFrame:
    """One row per conversation. ``turns`` has conv_id, turn, role, text and may have ``parts`` (array of PART),
    which then stands for the text wherever it is not null."""
    small_batches(turns.sparkSession, 2000)
    typed = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), typed.alias("parts"))
    schema_out = _arrow_type()

    def fmt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now: Conversation | None = None
        for b in batches:
            for c, role, text, parts in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text", "parts"))):
                if now is None or c != now.conv_id:
                    done += [now.row()] if now else []
                    now = Conversation(c, rates)
                now.add(role, [{"type": "text", "text": text}] if parts is None else [p for p in parts if p])
            if len(done) >= 500:
                yield pa.RecordBatch.from_pylist(done, schema=schema_out)
                done = []
        done += [now.row()] if now else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema_out)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(fmt, OUT)


def _arrow_type() -> pa.Schema:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    found = pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())])
    return pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(span)),
                      ("attachments", pa.list_(found)), ("expanded_tokens", pa.int64())])


def write_and_read(formatted: DataFrame, path: str | None = None) -> DataFrame:
    path = path or shared_path(formatted.sparkSession, "formatted-chat")
    formatted.write.option("compression", "zstd").parquet(path)
    return formatted.sparkSession.read.schema(formatted.schema).parquet(path)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says about itself: its turns parsed back, the text under the loss mask."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, text, spans, found in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_spans", "attachments"))):
                turns = parse(text)
                learned = [unescape(text[s["start"]:s["stop"]]) for s in spans]
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, learned)), sha("".join(learned)), len(text), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.string() if i in (2, 4) else pa.int64()) for i, col in enumerate(zip(*out))] if out
                                             else [pa.array([], pa.string() if i in (2, 4) else pa.int64()) for i in range(7)],
                                             names=[x.split()[0] for x in DIGEST.split(", ")])
    return formatted.mapInArrow(read, DIGEST)
