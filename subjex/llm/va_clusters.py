"""Centroid clustering over a vector-approximation file.

Method. Vectors become integers and are written twice: whole, and as an
approximation of ``BITS`` bits per dimension, the number of the cell (of equal width
between the dimension's extremes) that holds the component. For a set of
centroids, lookup tables give for every dimension and cell the least and
the greatest squared difference to each centroid, and for every two centroids the least
difference of the two; summed over the dimensions they are intervals of the
distance. All table entries are integers, so the bounds are exact.

A round reads the approximations only. A vector whose intervals leave one
centroid, before and after the last move of the centroids, and the same one, has
changed nothing. All other vectors are open: their rows are
fetched from the whole vectors by a join on the row number, and their exact
distances tell which cluster they leave and which they join. The sums of the
clusters are carried from round to round by these differences, so means are
exact without reading what has not moved. Only the first assignment and the
last, which returns distances, read every vector.

Scale. A round shuffles open rows alone, about their share of the data.
Centroids, tables, sums and counts have a fixed size (clusters times
dimensions); one row per cluster reaches the driver. Equal vectors are not grouped, so no
common vector lands in one task.

Defined results. Vectors that are null, not of ``DIM`` components, or hold a
null or non-finite component have no row. Repeated rows count each; equal distances go to
the smaller cluster number. Rows whose vec_id is null hash as the empty string. Start vectors with
equal hashes (repeated vec_ids) are ordered by their components. With fewer kept vectors than
clusters there are as many clusters as vectors; an empty table gives no rows. Components
beyond 2^26 after scaling would overflow a 64-bit distance and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import materialise

DIM, SCALE, BITS = 64, 1024.0, 6
LIMIT = 1 << 26
#: Vectors at a time inside a task.
STEP = 2048


def scaled(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v): the kept vectors as integers."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # a condition on size comes first in the same expression: longer arrays are not searched
    kept = vectors.where(F.when(F.size(e) == dim, finite).otherwise(False)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    small = F.forall(F.col("embedding"), lambda x: F.abs(x.cast("double") * SCALE) < float(LIMIT))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return kept.select("vec_id", F.when(small, v).otherwise(F.raise_error(F.lit("a component lies beyond the range of exact distances"))).alias("v"))


def start(whole: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of smallest hash of their ids, in hash order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), dim)


def pack_cells(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of cell numbers as rows of packed bytes."""
    return np.packbits(np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(cells), -1), axis=1)


def unpack_cells(packed: np.ndarray, dim: int, bits: int) -> np.ndarray:
    flags = np.unpackbits(packed, axis=1)[:, :dim * bits].reshape(len(packed), dim, bits)
    return (flags @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)).astype(np.int64)


class Grid:
    """Cells of equal width between the least and the greatest component of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low, self.high, self.bits, self.dim = low, high, bits, len(low)
        self.width = (high - low) // (1 << bits) + 1

    def cells(self, v: np.ndarray) -> np.ndarray:
        return (v - self.low) // self.width

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest integer of each cell, by (dimension, cell)."""
        low = self.low[:, None] + np.arange(1 << self.bits) * self.width[:, None]
        return low, np.minimum(low + self.width[:, None] - 1, np.maximum(self.high[:, None], low))


class Tables:
    """Distance intervals for one set of centroids."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.grid, self.centroids = grid, centroids
        low, high = grid.ends()
        a, b = low[None] - centroids[:, :, None], high[None] - centroids[:, :, None]  # (cluster, dimension, cell)
        far = np.maximum(a * a, b * b)
        near = np.where((a <= 0) & (b >= 0), 0, np.minimum(a * a, b * b))
        by_cell = lambda t: np.ascontiguousarray(t.transpose(1, 2, 0)).reshape(-1, len(centroids))
        self.near, self.far = by_cell(near), by_cell(far)
        # least of (x - c)^2 - (x - r)^2 in a cell: linear in x, so it lies at one of the cell's ends
        c, r = centroids[None, :, :, None], centroids[:, None, :, None]
        apart = c * c - r * r + np.minimum(2 * low * (r - c), 2 * high * (r - c))  # (r, c, dimension, cell)
        self.apart = [by_cell(apart[k]) for k in range(len(centroids))]

    def sure(self, cells: np.ndarray) -> np.ndarray:
        """The nearest centroid of each approximated vector, or -1 where intervals leave several."""
        at = cells + np.arange(self.grid.dim) * (1 << self.grid.bits)
        best = np.argmin(self.far[at].sum(1), axis=1)
        out = np.full(len(cells), -1)
        least = self.far[at].sum(1).min(1)
        alone = (self.near[at].sum(1) <= least[:, None]).sum(1) == 1
        out[alone] = best[alone]
        for r in range(len(self.centroids)):
            mine = np.flatnonzero(~alone & (best == r))
            if len(mine):
                more = self.apart[r][at[mine]].sum(1)
                more[:, r] = 1
                out[mine[(more > 0).all(1)]] = r
        return out


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number among equals) and squared distance, in integers."""
    d = np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(v)), best]


SUMS = "cluster int, n long, total array<long>"


def _sums_rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    there = np.flatnonzero(counts.astype(bool) | sums.astype(bool).any(1))
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there], pa.int64()), pa.array(sums[there].tolist(), pa.list_(pa.int64()))],
                                      names=["cluster", "n", "total"])


def _add(own: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Add the differences of all tasks: one row per cluster comes to the driver."""
    dim = len(sums[0])
    total = own.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"))
    for r in total.collect():
        counts[r["cluster"]] += r["n"]
        sums[r["cluster"]] = [a + b for a, b in zip(sums[r["cluster"]], r["total"])]


def all_sums(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Sums by nearest centroid over every whole vector."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v = _matrix(b.column("v"), dim).astype(np.int64)
            best, _ = nearest(v, centroids)
            np.add.at(sums, best, v)
            counts += np.bincount(best, minlength=k)
        yield _sums_rows(sums, counts)
    return whole.select("v").mapInArrow(run, SUMS)


def approximate(whole: DataFrame, grid: Grid) -> DataFrame:
    """(row, cells) of every whole vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pack_cells(grid.cells(_matrix(b.column("v"), grid.dim).astype(np.int64)), grid.bits)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([p.tobytes() for p in packed], pa.binary())], names=["row", "cells"])
    return whole.select("row", "v").mapInArrow(run, "row long, cells binary")


def open_rows(approximations: DataFrame, grid: Grid, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """(row) of the vectors that the approximation cannot place under both sets of centroids, or that it places apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = Tables(grid, old), Tables(grid, new)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, STEP):
                b = whole_batch.slice(lo, STEP)
                packed = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                cells = unpack_cells(packed, grid.dim, grid.bits)
                x = after.sure(cells)
                pick = x < 0
                rest = np.flatnonzero(~pick)
                pick[rest] = before.sure(cells[rest]) != x[rest]
                yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(pick))], names=["row"])
    return approximations.mapInArrow(run, "row long")


def moved_sums(fetched: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """What the fetched vectors add to the clusters they join and take from those they leave."""
    k, dim = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v = _matrix(b.column("v"), dim).astype(np.int64)
            was, now = nearest(v, old)[0], nearest(v, new)[0]
            apart = was != now
            np.add.at(sums, now[apart], v[apart])
            np.subtract.at(sums, was[apart], v[apart])
            counts += np.bincount(now[apart], minlength=k) - np.bincount(was[apart], minlength=k)
        yield _sums_rows(sums, counts)
    return fetched.select("v").mapInArrow(run, SUMS)


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(row, vec_id, cluster, distance) of every whole vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, d = nearest(_matrix(b.column("v"), dim).astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])
    return whole.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def fit(whole: DataFrame, clusters: int, rounds: int, seed: int, bits: int = BITS, dim: int = DIM) -> tuple[np.ndarray, list[int]]:
    """The centroids after all rounds, and the number of vectors fetched in each round but the first."""
    centroids = start(whole, clusters, seed)
    if not len(centroids) or not rounds:
        return centroids, []
    ends = whole.agg(*(f(F.col("v")[i]).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(dim))).first()
    grid = Grid(np.array(ends[:dim], np.int64), np.array(ends[dim:], np.int64), bits)
    approximations = materialise(approximate(whole, grid), "approximations")
    k = len(centroids)
    sums, counts, fetched = [[0] * dim for _ in range(k)], [0] * k, []
    _add(all_sums(whole, centroids), sums, counts)
    for _ in range(rounds - 1):
        moved = _means(sums, counts, centroids)
        need = materialise(open_rows(approximations, grid, centroids, moved), "open-rows")
        fetched.append(need.count())
        if fetched[-1]:
            _add(moved_sums(whole.join(need, "row", "left_semi"), centroids, moved), sums, counts)
        centroids = moved
    return _means(sums, counts, centroids), fetched


def _means(sums: list[list[int]], counts: list[int], centroids: np.ndarray) -> np.ndarray:
    """Floors of the means; a cluster without vectors keeps its centroid."""
    return np.array([[s // n for s in total] if n else own.tolist() for total, n, own in zip(sums, counts, centroids)], np.int64)


def centroid_sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, bits: int = BITS, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, cluster, distance) of ``vectors`` (vec_id, embedding), and the centroids (cluster, centroid, centroid_sha256)."""
    spark = vectors.sparkSession
    whole = materialise(scaled(vectors, dim).withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    centroids, _ = fit(whole, clusters, rounds, seed, bits, dim)
    named = spark.createDataFrame([(i, c.tolist(), centroid_sha256(c)) for i, c in enumerate(centroids)], "cluster int, centroid array<long>, centroid_sha256 string")
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), named
    return materialise(assigned(whole, centroids), "clustered-vectors"), named


def with_inertia(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Rows with the summed distances of their cluster and of all, and the digest of their centroid."""
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per cluster
    total = sum(r["cluster_inertia"] for r in per)
    spark = rows.sparkSession
    sums = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in per], "cluster int, cluster_inertia long, inertia long")
    per_cluster = sums.join(centroids.select("cluster", "centroid_sha256"), "cluster")
    return rows.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
