"""Records that span lines, read in parallel.

A quoted CSV field may hold line ends, and a Turtle statement takes several lines, so a
split that starts in the middle of a file does not know whether its first line
continues a record. Spark reads the lines of all splits in parallel, and three steps
put records together:

1. every split says, for each state its first line might begin in, the state after its
   last line (for CSV: inside or outside quotes);
2. these maps are composed along each file, a row per split, which gives the state each
   split really begins in;
3. every split cuts its lines into records. What begins before the split or ends after
   it becomes a fragment; fragments are few (two per split at most) and are joined in file order.

A format gives two functions on lists of lines: ``pass_through(lines, state)`` -> state after them, and
``ends(lines, state)`` -> (which lines end a record, state after them). Only what stands between the two is
kept in a task: the state and an unfinished record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
PARTS = "file string, start long, line long, kind int, first boolean, text string"


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, start, line, value): every line with its file, the byte at which its split starts, and a number that
    grows within the split. Lines end at line feeds; a carriage return before one stays in the value."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(paths if isinstance(paths, str) else list(paths))
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("line"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """Slices of one split, in order; the flag says that the split begins."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file").to_pylist(), b.column("start").to_numpy()
        new = np.append(True, (start[1:] != start[:-1]) | np.array([x != y for x, y in zip(file[1:], file)], bool))
        cuts = np.append(np.flatnonzero(new), b.num_rows)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = (file[lo], int(start[lo]))
            yield key, key != before, b.slice(lo, hi - lo)
            before = key


def _state_maps(lines: DataFrame, states: int, pass_through: Callable) -> DataFrame:
    """(file, start, map): the state after each split for each state before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, after = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([after], pa.list_(pa.int32()))], names=["file", "start", "map"])
        for own, begins, b in _runs(batches):
            if begins:
                if key is not None:
                    yield row()
                key, after = own, list(range(states))
            values = b.column("value").to_pylist()
            to = {s: pass_through(values, s) for s in set(after)}  # states meet soon
            after = [to[s] for s in after]
        if key is not None:
            yield row()
    return lines.select("file", "start", "value").mapInArrow(run, "file string, start long, map array<int>")


def split_states(lines: DataFrame, states: int, pass_through: Callable) -> DataFrame:
    """(file, start, state): the state in which each split begins; a file begins in state 0."""
    maps = _state_maps(lines, states, pass_through)
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of a file
    before = F.collect_list("map").over(w)
    return maps.select("file", "start", F.aggregate(before, F.lit(0), lambda s, m: F.element_at(m, s + 1)).alias("state"))


def records(lines: DataFrame, states: int, pass_through: Callable, ends: Callable) -> DataFrame:
    """(file, start, line, first, text): every record of every file; ``first`` marks a file's first one, and
    (file, start, line) orders the records of a file."""
    begin = split_states(lines, states, pass_through)
    # a split lies in one task; sorting by line restores its order whatever the join does
    dealt = lines.join(begin, ["file", "start"]).sortWithinPartitions("file", "start", "line").select("file", "start", "line", "state", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, out = None, None, []

        def close():
            # what is open when the split is over goes on in the next one
            if open_ is not None and open_["lines"]:
                out.append((*key, open_["line"], MIDDLE if open_["head"] else TAIL, open_["first"], "\n".join(open_["lines"])))

        def flush():
            cols = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))],
                                              names=["file", "start", "line", "kind", "first", "text"])
        for own, begins, b in _runs(batches):
            if begins:
                if key is not None:
                    close()
                key, state = own, b.column("state")[0].as_py()
                open_ = {"lines": [], "line": b.column("line")[0].as_py(), "head": state != 0, "first": own[1] == 0}
            values, number = b.column("value").to_pylist(), b.column("line").to_pylist()
            last, state = ends(values, state)
            at = 0
            for i in np.flatnonzero(last).tolist():
                open_["lines"] += values[at:i + 1]
                out.append((*key, open_["line"], HEAD if open_["head"] else WHOLE, open_["first"], "\n".join(open_["lines"])))
                at = i + 1
                open_ = {"lines": [], "line": number[i] + 1, "head": False, "first": False}
            open_["lines"] += values[at:]
            yield flush()
            out.clear()
        if key is not None:
            close()
            yield flush()
    parts = dealt.mapInArrow(run, PARTS)
    whole = parts.where(F.col("kind") == WHOLE).select("file", "start", "line", "first", "text")
    # fragments in file order: a tail begins a record, a head ends one
    pieces = parts.where(F.col("kind") != WHOLE)
    w = Window.partitionBy("file").orderBy("start", "line").rowsBetween(Window.unboundedPreceding, 0)  # two rows per split at most
    numbered = pieces.withColumn("record", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(w))
    joined = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("start", "line", "text", "first"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["line"].alias("line"), F.col("p")[0]["first"].alias("first"),
                           F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined)


# ------------------------------------------------------------------ CSV

def _csv_pass(lines: list[str], state: int) -> int:
    return (state + sum(v.count('"') for v in lines)) % 2


def _csv_ends(lines: list[str], state: int) -> tuple[np.ndarray, int]:
    inside = (state + np.cumsum([v.count('"') for v in lines])) % 2
    return inside == 0, int(inside[-1]) if len(lines) else state


def csv_records(spark: SparkSession, paths: str | Sequence[str], schema, glob: str | None = None, recursive: bool = False, header: bool = True,
                null_value: str = "") -> DataFrame:
    """(file, start, line, the columns of ``schema``): CSV with doubled quotes, whose quoted fields may hold line ends.

    Many tasks read one file. A field with a quote is quoted as a whole, as CSV writers do; blank lines outside quotes are
    no records; a file's first record is its header. Line ends inside a field come back as they were written."""
    raw = records(read_lines(spark, paths, glob, recursive), 2, _csv_pass, _csv_ends)
    text = F.regexp_replace("text", "\r$", "")
    raw = raw.where((F.trim(text) != "") & ~(F.col("first") & F.lit(header)))
    # the parser ends a record at a bare line feed only outside quotes; multiLine keeps carriage returns inside them
    options = {"escape": '"', "quote": '"', "nullValue": null_value, "mode": "PERMISSIVE", "multiLine": "true", "header": "false"}
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return raw.select("file", "start", "line", F.from_csv(text, F.lit(ddl), options).alias("_r")).select("file", "start", "line", "_r.*")
