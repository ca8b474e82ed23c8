"""Nearest-label search as Spark jobs (M1 exact, F13; the persisted index of M4 is in `vector_index`).

Exact search is a blocked matrix product: queries are hashed into Q blocks
and the vocabulary into V blocks so that one block of each fits a task's
memory budget; each query block meets each vocabulary block once (queries
replicated V times, vocabulary Q times, nothing else), a task multiplies its
two blocks in numpy, a tile of a million values at a time, and emits only the k best labels per query, and a
per-query top-k merges the V partial lists. Labels of equal vectors are multiplied k times at most. No (query, label) pair is ever
emitted and nothing is broadcast; block counts follow measured sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cosines are compared at this many digits: equal vectors tie wherever they stand in a product.
DIGITS = 12
#: Labels whose largest value is looked at first; values of a product, rows and columns of its tiles, and exact cosines held at a time.
GROUP, CELLS, TILE, SLICE = 64, 4_000_000, 1024, 50_000
RESULT_SCHEMA = "query_id long, label_id string, label_text string, cosine double"


def block_count(n_rows: int, row_bytes: int, budget_bytes: int, parallelism: int = 1,
                min_rows: int = 50_000) -> int:
    """Blocks so that one fits the memory budget, and, when there is enough
    data (``min_rows`` per block), at least enough blocks to occupy the
    cluster's cores."""
    by_size = math.ceil(n_rows * row_bytes / budget_bytes)
    by_cores = min(parallelism, n_rows // min_rows)
    return max(1, by_size, by_cores)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores a round-robin repartition
    (small inputs only: a big input has many splits and is left alone)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _size(df: DataFrame, col: str = "embedding") -> tuple[int, int]:
    """Row count and vector dimension in one aggregate job."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    return int(r["n"]), int(r["d"] or 0)


def _first_of_equal(v: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``v`` that may be among the k best of some query: of rows of the very same values only the k first by ``place`` can."""
    bits = np.ascontiguousarray(v, np.float64).view(np.uint64)
    mixed = np.zeros(len(v), np.uint64)
    for col in bits.T:  # a hash of each row; what it brings together is compared below
        mixed = (mixed ^ col) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((place, mixed))
    begins = np.append(True, mixed[order][1:] != mixed[order][:-1])
    at = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    same = (bits[order] == bits[order[at[run]]]).all(1)
    before = np.cumsum(same) - same
    return order[~same | (before - before[at[run]] < k)]


def _topk_rows(q: np.ndarray, v: np.ndarray, place: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, label, cosine) of the k best labels of each query in one pair of blocks, ties by ``place``.

    A product in single precision with a bound on its error leaves few candidates: a label cannot be among the k best
    unless it reaches the k-th of the largest values of ``GROUP`` labels each. They get their cosine in double precision.
    Equal vectors are multiplied k times at most: a label text that many concepts share ties with all its copies, and they would all be candidates."""
    if not len(v):
        return
    kept = _first_of_equal(v, place, k)
    v, place = v[kept], place[kept]
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    vn = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    n, group = len(vn), max(1, min(GROUP, len(vn) // k))
    groups, every = -(-n // group), n <= k
    # one more component tells labels (0) from what fills the last group or is no number (-4, below any cosine)
    v32, bad = np.zeros((groups * group, vn.shape[1] + 1), np.float32), ~np.isfinite(vn).all(1)
    v32[:n, :-1], v32[:n, -1], v32[n:, -1] = np.where(bad[:, None], 0, vn), np.where(bad, -4, 0), -4
    slack, chunk, step = 2 * (vn.shape[1] + 8) * 2.0 ** -23, max(1, min(TILE, CELLS // groups)), max(1, TILE // group)
    by_group = v32.reshape(groups, group, -1)
    for lo in range(0, len(qn), chunk):
        own = qn[lo:lo + chunk]
        if every:
            qi, li = (x.reshape(-1) for x in np.indices((len(own), n)))
        else:
            q32 = np.hstack([own, np.ones((len(own), 1))]).astype(np.float32)
            most = np.empty((groups, len(own)), np.float32)
            for at in range(0, groups, step):  # a tile of the product at a time: labels by queries, so that maxima run along the queries
                tile = v32[at * group:(at + step) * group] @ q32.T
                np.maximum.reduce(tile.reshape(-1, group, len(own)), axis=1, out=most[at:at + step])
            least = -np.partition(-most, k - 1, axis=0)[k - 1] - slack
            g, qg = np.nonzero(most >= least)
            hits = []
            for at in range(0, len(g), TILE):
                guess = np.matmul(by_group[g[at:at + TILE]], q32[qg[at:at + TILE], :, None])[:, :, 0]
                row, col = np.nonzero(guess >= least[qg[at:at + TILE], None])
                hits.append((qg[at + row], g[at + row] * group + col))
            qi, li = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            real = li < n
            qi, li = qi[real], li[real]
        score = np.empty(len(qi))
        for at in range(0, len(qi), SLICE):
            score[at:at + SLICE] = np.einsum("nd,nd->n", own[qi[at:at + SLICE]], vn[li[at:at + SLICE]])
        score = np.round(score, DIGITS)
        order = np.lexsort((place[li], -score, qi))
        qi, li, score = qi[order], li[order], score[order]
        begin = np.searchsorted(qi, np.arange(len(own)))
        best = np.arange(len(qi)) - begin[qi] < k
        yield qi[best] + lo, kept[li[best]], score[best]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    arr = col.combine_chunks()
    lengths = np.unique(pc.list_value_length(arr).to_numpy(zero_copy_only=False))
    if arr.null_count or len(lengths) > 1:
        raise ValueError("vectors must be present and of one length")
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def nearest(queries: DataFrame, vocab: DataFrame, k: int = 1,
            query_block_bytes: int = 32 << 20, vocab_block_bytes: int = 32 << 20) -> DataFrame:
    """M1: the k labels of greatest cosine per query (ties: smaller label_id).

    ``queries``: (query_id long, embedding array<float>), distinct queries.
    ``vocab``: (label_id string, label_text string, embedding array<float>).
    Returns (query_id, label_id, label_text, cosine) with cosine in double.
    """
    nq, _ = _size(queries)
    nv, dim = _size(vocab)
    row_bytes = 8 * max(dim, 1) + 64
    cores = queries.sparkSession.sparkContext.defaultParallelism
    bq = block_count(nq, row_bytes, query_block_bytes)
    bv = block_count(nv, row_bytes, vocab_block_bytes, 2 * cores, min_rows=10_000)
    # more partitions than pairs, or hashes would put several pairs into one task while others have none
    tasks = 1 if bq * bv == 1 else min(8 * bq * bv, max(16 * cores, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # fresh attributes on each side: both may derive from one table
    q = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("embedding"),
                       F.pmod(F.xxhash64("query_id"), F.lit(bq)).cast("int").alias("qb"),
                       F.explode(F.sequence(F.lit(0), F.lit(bv - 1))).alias("vb"))
    v = vocab.select(F.col("label_id").alias("label_id"), F.col("label_text").alias("label_text"),
                     F.col("embedding").alias("embedding"),
                     F.pmod(F.xxhash64("label_id"), F.lit(bv)).cast("int").alias("vb"),
                     F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            order = pc.sort_indices(right.select(["label_id", "label_text"]), sort_keys=[("label_id", "ascending"), ("label_text", "ascending")]).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            found = [*_topk_rows(_matrix(left.column("embedding")), _matrix(right.column("embedding")), place, k)]
        qi, li, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([left.column("query_id").take(pa.array(qi)), right.column("label_id").take(pa.array(li)), right.column("label_text").take(pa.array(li)), pa.array(s)],
                        names=["query_id", "label_id", "label_text", "cosine"])

    # a count of its own: products cost more than their bytes tell, so tasks are not merged by size
    q, v = (x.repartition(tasks, "qb", "vb") for x in (q, v))
    partial = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(score, RESULT_SCHEMA)
    return top_k(partial, k, "query_id", "cosine")


def top_k(df: DataFrame, k: int, key: str, score: str) -> DataFrame:
    """Per-key top-k, ties by label_id, then label_text or row. A row_number filter, which Spark
    limits per group before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *(c for c in ("label_id", "label_text", "row") if c in df.columns))
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


# ------------------------------------------------------------------ M4

def nearest_clusters(queries: DataFrame, vocab: DataFrame, k: int = 1, n_clusters: int = 16, n_probe: int | None = None,
                     seed: int = 7, recall: float = 0.95, sample: int = 1000, exact: bool = False) -> DataFrame:
    """M4 in one call: an index of ``vocab`` (:mod:`subjex.operators.vector_index`) built for these queries and searched.

    Probes ``n_probe`` clusters, or as many as ``sample`` of the queries need to find the share ``recall`` of
    their exact k nearest labels. Build the index once and keep it where a vocabulary is searched more than once."""
    from subjex.operators.vector_index import build_index, search
    index = build_index(vocab, n_clusters=n_clusters, seed=seed, queries=queries, recall=recall, k=k, n_queries=sample, n_probe=n_probe)
    return search(index, queries, k, exact=exact)
