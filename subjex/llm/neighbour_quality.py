"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Method. A text becomes weighted counts of three families of terms: neighbouring
byte kinds (how it is typed), words that repeat one of the words just before
(how it repeats itself), and hashed words with their shapes (what it says).
Log counts are weighted by inverse document frequency and scaled to length one
in each family. A truncated singular value decomposition of the labelled rows
gives the latent space. Labelled vectors are broadcast; each batch of documents is
multiplied with all of them at once (exact cosines, block by block), and the
``neighbours`` nearest labels vote with weight similarity to a power.

Bounds. The model is fit in one task on at most ``max_labelled`` labelled rows
(smallest hashes of doc_id, outside the held-out fold): ``max_labelled`` x
``rank`` floats are broadcast whatever the corpus. Applying it is one pass
without a shuffle over every whole text; counts add up over the segments of a
long text.

Defined results. Null text is empty text. An empty text has no terms and gets
the share of label 1 among the labelled rows. Rows that repeat a doc_id are
scored one by one. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import held_out, small_batches, text_or_empty
from subjex.llm.words import VISIBLE, buffers, byte_classes, hash_runs, segments

_UPPER, _DIGIT, _LOWER = byte_classes((65, 90)), byte_classes((48, 57)), byte_classes((97, 122), (128, 255))
#: Kinds of bytes: lower-case letters and all beyond ASCII, capitals, digits, space, line end, each other sign by itself.
KIND = np.zeros(256, np.int64)
for _n, _b in enumerate([b for b in range(256) if not (_UPPER[b] or _DIGIT[b] or _LOWER[b] or b in (32, 10))]):
    KIND[_b] = 5 + _n % 59
KIND[_UPPER], KIND[_DIGIT], KIND[32], KIND[10] = 1, 2, 3, 4
KINDS, LAGS, WORDS = 64, 8, 2048
FAMILIES = ((0, KINDS * KINDS, 1.0), (KINDS * KINDS, KINDS * KINDS + LAGS + 1, 1.0), (KINDS * KINDS + LAGS + 1, KINDS * KINDS + LAGS + 1 + WORDS, 0.35))
TERMS = FAMILIES[-1][1]
SCORED = "doc_id long, held_out boolean, score double"


def log_counts(col: pa.Array) -> np.ndarray:
    """(texts x TERMS) logarithms of one and the term counts of a column without nulls."""
    data, offsets = buffers(col)
    out = np.zeros(len(col) * TERMS, np.float32)
    for lo, hi in segments(data, offsets, VISIBLE):
        seg = data[lo:hi]
        of = np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1
        kind = KIND[seg]
        same = of[1:] == of[:-1]
        _add(out, of[1:][same], (kind[:-1] * KINDS + kind[1:])[same])
        member = VISIBLE[seg]
        first = member.copy()
        first[1:] &= ~(member[:-1] & same)
        starts = np.flatnonzero(first)
        if len(starts):
            h, doc = hash_runs(seg, starts, member), of[starts]
            lag = np.zeros(len(h), np.int64)
            for k in range(LAGS, 0, -1):
                lag[k:][(h[k:] == h[:-k]) & (doc[k:] == doc[:-k])] = k
            _add(out, doc, FAMILIES[1][0] + lag)
            _add(out, doc, FAMILIES[2][0] + (h % np.uint64(WORDS)).astype(np.int64))
    return np.log1p(out).reshape(len(col), TERMS)


def _add(out: np.ndarray, doc: np.ndarray, term: np.ndarray) -> None:
    at, n = np.unique(doc * TERMS + term, return_counts=True)
    out[at] += n


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    for a, b, share in FAMILIES:
        part = x[:, a:b]
        x[:, a:b] = part * (share / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9))
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def fit(counts: np.ndarray, labels: np.ndarray, rank: int) -> dict:
    """Inverse document frequencies, projection, unit vectors and labels of the labelled rows."""
    idf = (1 + np.log((1 + len(counts)) / (1 + (counts > 0).sum(0)))).astype(np.float32)
    x = _weighted(counts, idf)
    rank = min(rank, len(x))
    q = x.T @ np.random.Generator(np.random.PCG64(5)).standard_normal((len(x), min(len(x), rank + 16))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ v[:rank].T).astype(np.float32)
    return {"idf": idf, "projection": projection, "vectors": _unit(x @ projection), "labels": labels.astype(np.float32), "prior": float(labels.mean())}


def vote(model: dict, counts: np.ndarray, neighbours: int, power: float, block: int = 128) -> np.ndarray:
    """Share of label 1 among the nearest labelled rows, weighted by similarity."""
    k, out = min(neighbours, len(model["labels"])), []
    for i in range(0, len(counts), block):
        part = counts[i:i + block]
        sims = _unit(_weighted(part, model["idf"]) @ model["projection"]) @ model["vectors"].T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(sims, near, 1), 1e-6, 1.0) ** power
        score = (weight * model["labels"][near]).sum(1) / weight.sum(1)
        out.append(np.where(part.any(1), score, model["prior"]))
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int, rank: int) -> dict | None:
    """Fit in one task; the driver receives the model only."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    rows = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
            .select("doc_id", "text", F.col("label").cast("int").alias("label")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = log_counts(b.column("text")).astype("<f2")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "label", "counts"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((d, y, c) for b in batches for d, y, c in zip(*(b.column(n).to_pylist() for n in ("doc_id", "label", "counts"))))
        if got:
            counts = np.frombuffer(b"".join(c for *_, c in got), "<f2").reshape(len(got), TERMS).astype(np.float32)
            made = pickle.dumps(fit(counts, np.array([y for _, y, _ in got]), rank))
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    counted = rows.mapInArrow(count, "doc_id long, label int, counts binary")
    got = counted.repartition(1).mapInArrow(solve, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else None


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4096, rank: int = 64,
                  neighbours: int = 15, power: float = 4.0) -> DataFrame:
    """(doc_id, held_out, score) of every row; only texts are scored on."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, max_labelled, rank))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = [np.full(min(64, b.num_rows - i), 0.5) if model is None else vote(model, log_counts(b.column("text").slice(i, 64)), neighbours, power)
                      for i in range(0, b.num_rows, 64)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text")).mapInArrow(score, SCORED)
