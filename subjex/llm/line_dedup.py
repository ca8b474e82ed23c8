"""Line dedup: a sharded minimal perfect hash over the repeated lines; documents probe its arrays.

Method. One aggregation counts, for every distinct line key, the documents
that hold it and the largest doc_id among them (partial sums before the
shuffle, so a line in a third of all documents is one row per task). Keys
found often enough go to shards by the top bits of their 64-bit hash; each
shard becomes a minimal perfect hash plus three arrays at its indices:
fingerprint (a second 64-bit hash), document count, largest doc_id. Documents
then probe the arrays batch by batch. Lines are never joined.

Bounds. A shard holds about ``shard_keys`` keys whatever the corpus. Arrays of
at most ``slice_mb`` together go to the executors as a broadcast. Larger ones
stay where they were written, and nothing of them passes through the driver:
the documents' line hashes travel to the shards once, in groups of about
``PROBES`` (a hot line's shard is copied to as many groups as its probes fill),
and the positions to drop come back to the texts by row number. The texts are
written once and read once however many shards there are.

Defined results. Null or empty text is one empty line. A row is a document:
rows that repeat a doc_id count as separate documents and a null doc_id ranks
below every number. An empty table gives an empty result. Extra input columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import SPACE, materialise, small_batches, text_or_empty
from subjex.llm.perfect_hash import PerfectHash

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(2**63)
#: Line hashes that meet one copy of a shard's arrays.
PROBES = 1 << 20
SHARD = "shard int, n int, sizes array<int>, bits binary, odd array<struct<h: long, fp: long, last_doc: long>>, fingerprint binary, n_docs binary, last_doc binary"
OUT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def line_keys(text: Column, min_chars: int) -> Column:
    """One key per line, null where the key is too short to count."""
    folded = F.translate(text, UPPER, UPPER.lower())
    return F.transform(F.split(folded, "\n", -1), lambda x: _long_or_null(F.btrim(x, F.lit(SPACE)), min_chars))


def _long_or_null(key: Column, min_chars: int) -> Column:
    return F.when(F.length(key) >= min_chars, key)


def _hash(key: Column) -> Column:
    return F.when(key.isNotNull(), F.xxhash64(key))


def _fingerprint(key: Column) -> Column:
    """A second 64-bit hash, independent of the first: murmur3 beside crc32."""
    return F.when(key.isNotNull(), F.shiftleft(F.hash(key).cast("long"), 32).bitwiseOR(F.crc32(key)))


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h, fp, n_docs, last_doc) of every key that at least ``min_docs`` documents hold."""
    keys = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
                       F.explode(F.array_distinct(line_keys(F.col("text"), min_chars))).alias("key")).where("key is not null")
    return (keys.select("doc_id", _hash(F.col("key")).alias("h"), _fingerprint(F.col("key")).alias("fp"))
            .groupBy("h", "fp").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
            .where(F.col("n_docs") >= min_docs))


def build_shards(lines: DataFrame, shard_keys: int) -> tuple[DataFrame, int]:
    """One row of arrays per shard of (h, fp, n_docs, last_doc), and the number of top bits of a hash that name its shard."""
    lines = materialise(lines, "repeated-lines")
    bits = max(0, math.ceil(math.log2(max(1, lines.count()) / shard_keys)))

    def build(key, rows):
        mph = PerfectHash.build(rows["h"].to_numpy(np.int64).view(np.uint64))
        odd = rows["h"].isin(mph.rest.view(np.int64))  # equal hashes of different keys: listed by themselves
        even = rows[~odd]
        order = np.argsort(mph.index(even["h"].to_numpy(np.int64).view(np.uint64)), kind="stable")
        row = {"shard": int(key[0]), "n": len(rows), "sizes": mph.sizes, "bits": mph.bits,
               "odd": rows.loc[odd, ["h", "fp", "last_doc"]].to_dict("records")}
        row |= {name: even[c].to_numpy(np.int64)[order].tobytes() for name, c in (("fingerprint", "fp"), ("n_docs", "n_docs"), ("last_doc", "last_doc"))}
        return pd.DataFrame([row])

    return lines.withColumn("shard", _shard(bits)).groupBy("shard").applyInPandas(build, SHARD), bits


def _shard(bits: int) -> Column:
    return (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("int")


class LineTable:
    """The arrays of some shards, ready to probe."""

    def __init__(self, rows: list[dict], bits: int):
        self.bits = bits
        self.shards = {}
        for r in rows:
            mph = PerfectHash(list(r["sizes"]), bytes(r["bits"]))
            self.shards[r["shard"]] = (mph, r["odd"], *(np.frombuffer(r[c], np.int64) for c in ("fingerprint", "last_doc")))

    def last_doc(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each probe: is it a repeated line, and the largest doc_id holding it."""
        found, last = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        key = h.view(np.uint64)
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for s in np.unique(at):
            if int(s) not in self.shards:
                continue
            mph, odd, fps, lasts = self.shards[int(s)]
            mine = np.flatnonzero(at == s)
            index = mph.index(key[mine])
            mine, index = mine[index >= 0], index[index >= 0]
            hit = fps[index] == fp[mine]
            found[mine[hit]], last[mine[hit]] = True, lasts[index[hit]]
            for x in odd:
                hit = (h == x["h"]) & (fp == x["fp"])
                found[hit], last[hit] = True, x["last_doc"]
        return found, last


def _probe(batch: pa.RecordBatch, lines: LineTable) -> list[np.ndarray]:
    """Per document of the batch, the positions of the lines to drop."""
    h, fp = (batch.column(c) for c in ("h", "fp"))
    ends = h.offsets.to_numpy().astype(np.int64) - h.offsets[0].as_py()
    flat = h.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    where = np.flatnonzero(there)
    hv = flat.drop_null().to_numpy().astype(np.int64)
    fv = fp.flatten().drop_null().to_numpy().astype(np.int64)
    found, last = lines.last_doc(hv, fv)
    doc = np.searchsorted(ends, where, side="right") - 1
    own = batch.column("rank_id").to_numpy()[doc]
    out = where[found & (last != own)]
    of = np.searchsorted(ends, out, side="right") - 1
    return [out[a:b] - ends[i] for i, (a, b) in enumerate(zip(*(np.searchsorted(of, np.arange(len(ends) - 1), s) for s in ("left", "right"))))]


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3,
                        shard_keys: int = 1 << 17, slice_mb: int = 64) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): texts without the lines that ``min_docs`` documents
    hold, except in the largest doc_id holding each."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shards, bits = build_shards(repeated_lines(docs, min_chars, min_docs), shard_keys)
    shards = materialise(shards, "line-shards")
    size = shards.agg(F.expr("sum(length(bits) * 8 + 40 * n)")).first()[0]
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("rank_id"), line_keys(F.col("text"), min_chars).alias("keys"))
    if (size or 0) <= slice_mb << 20:
        rows = [r.asDict() for r in shards.collect()]  # at most slice_mb
        hashed = keyed.select("doc_id", "text", "rank_id", F.transform("keys", _hash).alias("h"), F.transform("keys", _fingerprint).alias("fp"))
        return hashed.mapInArrow(_dropper(spark.sparkContext.broadcast((rows, bits))), OUT)
    kept = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "line-texts")
    return kept.join(_dropped_lines(kept, shards, bits, min_chars), "row", "left").select("doc_id", "text", "dropped").mapInArrow(_remove, OUT)


def _dropped_lines(docs: DataFrame, shards: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """(row, dropped): the positions of the lines to drop of each row that loses any. Line hashes
    travel to the shards' arrays, which stay in their files."""
    lines = (docs.select("row", F.coalesce("doc_id", F.lit(NO_ID)).alias("rank_id"), F.posexplode(line_keys(F.col("text"), min_chars)).alias("at", "key"))
             .where("key is not null").select("row", "rank_id", "at", _hash(F.col("key")).alias("h"), _fingerprint(F.col("key")).alias("fp")))
    lines = materialise(lines.withColumn("shard", _shard(bits)), "line-probes")
    copies = lines.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("copies"))
    shards = shards.join(copies, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    lines = lines.join(copies, "shard").withColumn("part", F.pmod(F.xxhash64("row", "at"), F.col("copies")).cast("int")).drop("copies")

    def probe(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        found, last = LineTable(arrays.to_dict("records"), bits).last_doc(probes["h"].to_numpy(np.int64), probes["fp"].to_numpy(np.int64))
        return probes.loc[found & (last != probes["rank_id"].to_numpy(np.int64)), ["row", "at"]]

    hits = lines.groupBy("shard", "part").cogroup(shards.groupBy("shard", "part")).applyInPandas(probe, "row long, at int")
    return hits.groupBy("row").agg(F.collect_list("at").alias("dropped"))


_TABLES: dict = {}


def _open(shared) -> LineTable:
    """Unpack the broadcast arrays once per Python worker, keeping only the latest."""
    if shared.value is not _TABLES.get("of"):
        _TABLES.update(of=shared.value, table=LineTable(*shared.value))
    return _TABLES["table"]


def _dropper(shared):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _open(shared)
        for b in batches:
            yield _without(b, _probe(b, lines))
    return drop


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _without(b, [x or [] for x in b.column("dropped").to_pylist()])


def _without(batch: pa.RecordBatch, dropped: list) -> pa.RecordBatch:
    """The output rows of a batch whose documents lose the lines at these positions."""
    texts, counts = [], []
    for text, out in zip(batch.column("text").to_pylist(), dropped):
        gone = set(map(int, out))
        counts.append(text.count("\n") + 1)
        texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([len(x) for x in dropped], pa.int64()), pa.array(texts, pa.string())],
                                      names=["doc_id", "n_lines", "n_dropped", "kept_text"])
