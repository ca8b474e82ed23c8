"""A persisted index for nearest-label search (M4): inverted file, residual codes, provable results.

Build (once per vocabulary). Unit vectors are dealt to the nearest of
``n_clusters`` centres; what is left of a vector beside its centre is cut into
parts, and each part becomes one byte, the number of its nearest codeword. Beside the codes
stands the length of what they miss, so a score estimated from codes comes with a
margin that holds for every unit query. Files are partitioned by
cluster; a meta table holds centres, codewords, cluster sizes and radii, and the number
of clusters to probe for a wanted recall, measured at build time.

Search. A query reads the clusters whose centres are nearest. Inside a task
lookup tables give the estimate of every vector; exact products are taken for
the best estimates, and then only where estimate plus margin reaches the k-th exact score. With
``exact`` a second pass reads every other cluster whose centre's score plus radius
reaches the k-th score found, so the result equals the exhaustive search.

Fitting (centres, codewords) uses a bounded sample, ``sample`` vectors by hash; every vector is
indexed. Queries travel to the index by broadcast if they take up to ``QUERY_BYTES``, else both sides meet by
cluster, a large cluster in several parts.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.operators.knn import DIGITS, top_k
from subjex.session import ensure_checkpoint_dir

CODEWORDS = 256
QUERY_BYTES = 64 << 20
#: Queries that share a lookup table at a time; rows of one cluster part in the joined search.
CHUNK, PART_ROWS = 256, 200_000
EPS = 1e-9
PARTIAL = "query_id long, label_id string, label_text string, cosine double, dots long"
ROWS = "label_id string, label_text string, cluster int, code binary, miss double, rest double, unit binary"


@dataclass
class VectorIndex:
    """The meta table of an index, read once: its size follows from the build's parameters."""
    spark: SparkSession
    path: str
    centres: np.ndarray
    words: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    n_probe: int

    def rows(self, clusters: list[int] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/rows")
        return df if clusters is None else df.where(F.col("cluster").isin(clusters))


def _unit(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres; one that loses all its rows keeps its place."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((c * c).sum(1)[None] - 2 * x[i:i + 8192] @ c.T).argmin(1) for i in range(0, len(x), 8192)])
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _coded(v: np.ndarray, centres: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, codes, length of what the codes miss, length of the rest beside the centre) of unit vectors."""
    cluster = ((centres * centres).sum(1)[None] - 2 * v @ centres.T).argmin(1)
    rest = v - centres[cluster]
    parts, _, width = words.shape
    cut = rest.reshape(len(v), parts, width)
    code = np.stack([((words[j] * words[j]).sum(1)[None] - 2 * cut[:, j] @ words[j].T).argmin(1) for j in range(parts)], axis=1)
    near = np.stack([words[j][code[:, j]] for j in range(parts)], axis=1)
    return cluster, code.astype(np.uint8), np.sqrt(((cut - near) ** 2).sum((1, 2))), np.sqrt((rest * rest).sum(1))


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _fit(vocab: DataFrame, n_clusters: int, parts: int, sample: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and codewords from ``sample`` vectors, in one task."""
    some = vocab.select("label_id", "label_text", "embedding").orderBy(F.xxhash64("label_id", "label_text"), "label_id", "label_text").limit(sample).select("embedding").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unit(b.column("embedding")) for b in batches if b.num_rows]
        if got:
            x, rng = np.concatenate(got), np.random.default_rng(seed)
            centres = _means(x, n_clusters, rounds, rng)
            rest = x - centres[((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)]
            words = np.zeros((parts, CODEWORDS, x.shape[1] // parts))
            for j, cut in enumerate(np.split(rest, parts, axis=1)):
                w = _means(cut, CODEWORDS, rounds, rng)
                words[j, :len(w)], words[j, len(w):] = w, w[0]
            yield pa.RecordBatch.from_arrays([pa.array([_packed({"centres": centres, "words": words})], pa.binary())], names=["model"])
    found = some.mapInArrow(run, "model binary").collect()
    if not found:
        return np.zeros((0, 1)), np.zeros((1, CODEWORDS, 1))
    model = np.load(io.BytesIO(bytes(found[0]["model"])))
    return model["centres"], model["words"]


def _parts(dim: int) -> int:
    """Two components to a part, where the dimension allows."""
    return dim // 2 if dim % 2 == 0 else dim


def build_index(vocab: DataFrame, path: str | None = None, n_clusters: int = 16, parts: int | None = None, sample: int = 50_000, rounds: int = 8, seed: int = 7,
                queries: DataFrame | None = None, recall: float = 0.95, k: int = 1, n_queries: int = 1000, n_probe: int | None = None) -> VectorIndex:
    """Index ``vocab`` (label_id, label_text, embedding) below ``path`` and open it.

    ``n_probe`` is taken as given, or measured: the fewest clusters by which ``n_queries`` of ``queries`` (by hash; the
    vocabulary's own vectors without any) find the share ``recall`` of their k exact nearest labels."""
    spark = vocab.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    dim = vocab.select(F.max(F.size("embedding"))).first()[0] or 1
    centres, words = _fit(vocab, n_clusters, parts or _parts(dim), sample, rounds, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _unit(b.column("embedding"))
                cluster, code, miss, rest = _coded(v, centres, words)
                yield pa.RecordBatch.from_arrays([b.column("label_id"), b.column("label_text"), pa.array(cluster, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()),
                                                  pa.array(miss), pa.array(rest), pa.array([x.tobytes() for x in v], pa.binary())],
                                                 names=["label_id", "label_text", "cluster", "code", "miss", "rest", "unit"])
    coded = vocab.select("label_id", "label_text", "embedding").mapInArrow(assign, ROWS)
    # by range of (cluster, hash), so a large cluster is written by several tasks
    coded.repartitionByRange("cluster", F.xxhash64("label_id", "label_text")).write.partitionBy("cluster").parquet(f"{path}/rows")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    if len(centres):
        for r in spark.read.parquet(f"{path}/rows").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("r")).collect():  # a row per cluster
            sizes[r["cluster"]], radii[r["cluster"]] = r["n"], r["r"]
    index = VectorIndex(spark, path, centres, words, sizes, radii, n_probe or len(centres))
    if n_probe is None and len(centres):
        index.n_probe = _probes(index, vocab if queries is None else queries, recall, k, n_queries)
    meta = _packed({"centres": centres, "words": words, "sizes": sizes, "radii": radii, "n_probe": np.array(index.n_probe)})
    spark.createDataFrame([(meta,)], "meta binary").coalesce(1).write.parquet(f"{path}/meta")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    meta = np.load(io.BytesIO(bytes(spark.read.parquet(f"{path}/meta").first()["meta"])))
    return VectorIndex(spark, path, meta["centres"], meta["words"], meta["sizes"], meta["radii"], int(meta["n_probe"]))


def _probes(index: VectorIndex, queries: DataFrame, recall: float, k: int, n_queries: int) -> int:
    own = F.col("query_id") if "query_id" in queries.columns else F.xxhash64("label_id", "label_text")
    some = queries.select(own.alias("query_id"), "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(n_queries)
    ids, q = _collected(some)
    exact = _search(index, ids, q, k, len(index.centres), True).select("query_id", "label_id", "label_text")
    homes = exact.join(index.rows().select("label_id", "label_text", "cluster"), ["label_id", "label_text"]).select("query_id", "cluster").collect()  # n_queries times k
    place = {i: r for r, i in enumerate(ids.tolist())}
    order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
    at = np.sort([int((order[place[r["query_id"]]] == r["cluster"]).argmax()) + 1 for r in homes])
    return int(at[math.ceil(recall * len(at)) - 1]) if len(at) else 1


def _collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a query set whose size was checked."""
    t = queries.select("query_id", "embedding").toArrow().combine_chunks()
    ids = t.column("query_id").to_numpy()
    col = t.column("embedding").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))
    return ids, _unit(col.chunk(0) if isinstance(col, pa.ChunkedArray) else col)


class _Scan:
    """Queries against the rows of a cluster: estimates from codes, exact products where they can still matter."""

    def __init__(self, centres: np.ndarray, words: np.ndarray, k: int):
        self.centres, self.words, self.k = centres, words, k

    def rows(self, ids: np.ndarray, q: np.ndarray, beat: np.ndarray, cluster: int, label_id: list, label_text: list, code: np.ndarray, miss: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows that may be among the k best of each query; ``beat``, the k-th score of each so far, is raised in place."""
        parts, _, width = self.words.shape
        for lo in range(0, len(ids), CHUNK):
            own = q[lo:lo + CHUNK]
            table = np.einsum("qjw,jcw->jqc", own.reshape(len(own), parts, width), self.words)
            guess = np.repeat((own @ self.centres[cluster])[:, None], len(code), axis=1)
            for j in range(parts):
                guess += table[j][:, code[:, j]]
            most, best = guess + miss + EPS, min(self.k, len(code))
            top = np.argpartition(-guess, best - 1, axis=1)[:, :best]
            tried = np.zeros(guess.shape, bool)
            tried[np.arange(len(own))[:, None], top] = True
            first = np.round(np.einsum("qd,qkd->qk", own, unit[top]), DIGITS)
            if best == self.k:
                np.maximum(beat[lo:lo + CHUNK], first.min(1), out=beat[lo:lo + CHUNK])
            qi, ri = np.nonzero((most >= beat[lo:lo + CHUNK, None]) & ~tried)
            score = np.round(np.einsum("nd,nd->n", own[qi], unit[ri]), DIGITS) if len(qi) else np.zeros(0)
            qa, ra = np.append(np.repeat(np.arange(len(own)), best), qi), np.append(top.reshape(-1), ri)
            s = np.append(first.reshape(-1), score)
            keep = s >= beat[lo:lo + CHUNK][qa] - EPS
            n = int(keep.sum())
            dots = np.zeros(n + 1, np.int64)
            dots[n] = len(s)  # a row without a query carries the number of exact products
            yield pa.RecordBatch.from_arrays([pa.array([*ids[lo:lo + CHUNK][qa[keep]].tolist(), None], pa.int64()),
                                              pa.array([*(label_id[i] for i in ra[keep].tolist()), None], pa.string()), pa.array([*(label_text[i] for i in ra[keep].tolist()), None], pa.string()),
                                              pa.array([*s[keep].tolist(), None], pa.float64()), pa.array(dots)], names=["query_id", "label_id", "label_text", "cosine", "dots"])


def _vectors(col: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


def _partials(index: VectorIndex, ids: np.ndarray, q: np.ndarray, k: int, wanted: np.ndarray, beat: np.ndarray) -> DataFrame:
    """Rows of the wanted (query, cluster) pairs that may be among the k best; queries by broadcast."""
    shared = index.spark.sparkContext.broadcast((ids, q, wanted, beat, index.centres, index.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted, beat, centres, words = shared.value
        beat, scan = beat.copy(), _Scan(centres, words, k)
        for b in batches:
            cluster = b.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                mine = np.flatnonzero(wanted[:, c])
                if not len(mine):
                    continue
                at = np.flatnonzero(cluster == c)
                part = b.take(pa.array(at))
                own = beat[mine]
                yield from scan.rows(ids[mine], q[mine], own, c, part.column("label_id").to_pylist(), part.column("label_text").to_pylist(),
                                     _vectors(part.column("code"), np.uint8), part.column("miss").to_numpy(), _vectors(part.column("unit"), np.float64))
                beat[mine] = own
    clusters = np.flatnonzero(wanted.any(0)).tolist()
    rows = index.rows(clusters).select("cluster", "label_id", "label_text", "code", "miss", "unit")
    return rows.mapInArrow(run, PARTIAL)


def _nearest_clusters(index: VectorIndex, q: np.ndarray, n_probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre scores, and which clusters are the nearest."""
    score = q @ index.centres.T
    wanted = np.zeros(score.shape, bool)
    wanted[np.arange(len(q))[:, None], np.argsort(-score, axis=1, kind="stable")[:, :n_probe]] = True
    return score, wanted


def _search(index: VectorIndex, ids: np.ndarray, q: np.ndarray, k: int, n_probe: int, exact: bool) -> DataFrame:
    """Partial rows (k best and ties are among them) for a query set in memory."""
    score, wanted = _nearest_clusters(index, q, n_probe)
    beat = np.full(len(ids), -np.inf)
    first = _partials(index, ids, q, k, wanted, beat)
    if exact and not wanted.all():
        from subjex.session import cut_lineage
        first = cut_lineage(first)
        place = {i: n for n, i in enumerate(ids.tolist())}
        for r in _best(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("s")).collect():  # a row per query in memory
            if r["n"] == k:
                beat[place[r["query_id"]]] = r["s"]
        more = (score + index.radii[None] + EPS >= beat[:, None]) & ~wanted
        if more.any():
            first = first.unionByName(_partials(index, ids, q, k, more, beat - EPS))
    return first


def _best(partials: DataFrame, k: int) -> DataFrame:
    return top_k(partials.where("query_id is not null").select("query_id", "label_id", "label_text", "cosine"), k, "query_id", "cosine")


def _joined(index: VectorIndex, queries: DataFrame, k: int, n_probe: int, beat: bool, only_more: bool) -> DataFrame:
    """As :func:`_partials` for query sets of any size: queries meet parts of clusters in cogroups."""
    centres, words, radii = index.centres, index.words, index.radii
    sub = np.maximum(1, -(-index.sizes // PART_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _unit(b.column("embedding"))
                score, wanted = _nearest_clusters(index_meta, q, n_probe)
                own = b.column("beat").to_numpy() if beat else np.full(len(q), -np.inf)
                if only_more:
                    wanted = (score + radii[None] + EPS >= own[:, None]) & ~wanted
                qi, c = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(qi)), pa.array([q[i].tobytes() for i in qi.tolist()], pa.binary()), pa.array(own[qi]), pa.array(c, pa.int32())],
                                                 names=["query_id", "unit", "beat", "cluster"])
    index_meta = VectorIndex(None, index.path, centres, words, index.sizes, radii, index.n_probe)
    cols = ["query_id", "embedding"] + (["beat"] if beat else [])
    parts = F.element_at(F.array(*(F.lit(int(n)) for n in sub)), F.col("cluster") + 1)
    qx = queries.select(cols).mapInArrow(probe, "query_id long, unit binary, beat double, cluster int").withColumn("sub", F.explode(F.sequence(F.lit(0), parts - 1))) \
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(_query_blocks(queries))).cast("int"))
    needed = qx.select("cluster", "qb").distinct().select(F.col("cluster").alias("cluster"), F.col("qb").alias("qb"))  # fresh attributes
    rows = index.rows().withColumn("sub", F.pmod(F.xxhash64("label_id", "label_text"), parts).cast("int")).join(needed, "cluster")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            c = left.column("cluster")[0].as_py()
            scan = _Scan(centres, words, k)
            out = list(scan.rows(left.column("query_id").to_numpy(), _vectors(left.column("unit"), np.float64), left.column("beat").to_numpy().copy(), c,
                                 right.column("label_id").to_pylist(), right.column("label_text").to_pylist(), _vectors(right.column("code"), np.uint8), right.column("miss").to_numpy(), _vectors(right.column("unit"), np.float64)))
        schema = pa.schema([("query_id", pa.int64()), ("label_id", pa.string()), ("label_text", pa.string()), ("cosine", pa.float64()), ("dots", pa.int64())])
        return pa.Table.from_batches(out, schema)
    keys = ["cluster", "sub", "qb"]
    right = rows.select("cluster", "sub", "qb", "label_id", "label_text", "code", "miss", "unit")
    return qx.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, PARTIAL)


def _query_blocks(queries: DataFrame) -> int:
    return max(1, math.ceil(queries.count() / 100_000))


def partials(index: VectorIndex, queries: DataFrame, k: int = 1, n_probe: int | None = None, exact: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Rows that hold the k best of every query, and rows without a query that count exact products (``dots``)."""
    n_probe = min(n_probe or index.n_probe, len(index.centres))
    if not len(index.centres):
        return index.spark.createDataFrame([], PARTIAL)
    if queries.count() * index.centres.shape[1] * 8 <= query_bytes:
        ids, q = _collected(queries)
        return _search(index, ids, q, k, n_probe, exact) if len(ids) else index.spark.createDataFrame([], PARTIAL)
    first = _joined(index, queries, k, n_probe, False, False)
    if exact and n_probe < len(index.centres):
        from subjex.session import cut_lineage
        first = cut_lineage(first)
        beat = _best(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("s"))
        known = queries.join(beat, "query_id", "left").select("query_id", "embedding", F.when(F.col("n") == k, F.col("s") - EPS).otherwise(float("-inf")).alias("beat"))
        first = first.unionByName(_joined(index, known, k, n_probe, True, True))
    return first


def search(index: VectorIndex, queries: DataFrame, k: int = 1, n_probe: int | None = None, exact: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, label_id, label_text, cosine): the k labels of greatest cosine per query (query_id, embedding), ties by
    label_id, among the probed clusters; with ``exact`` among all."""
    return _best(partials(index, queries, k, n_probe, exact, query_bytes), k)
