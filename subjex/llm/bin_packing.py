"""Best-fit packing of documents into sequences, with a lower bound that certifies each partition.

Method. Documents become ids, with an end id behind each; one longer than a
sequence is cut into pieces of its size, the rest is one piece. Pieces that fill a
sequence are done. The others are dealt by hash into partitions of about
``PART`` pieces, and every partition is packed by best-fit decreasing. Dual
feasible functions give a lower bound on the sequences any packing of its pieces needs:
the plain volume, the rounding functions u(k), the threshold functions that
let nothing ride beside a large piece, and the functions that count how many pieces of
a least size fit. A partition that uses as many sequences as its bound
is certified: no packing of it is better. From a partition with a gap all sequences that are
not full give their pieces back, and from a certified one the emptiest sequence does.
These pieces are dealt anew, so partitions exchange documents, and are packed
again; a round's result counts only if it needs fewer sequences than the pieces held
before. It ends when nothing was gained, or everything is certified as one partition.

Lengths are whole numbers up to the size of a sequence, so a partition is packed from its
histogram: the open sequences lie in piles by free space, and the best fit is
the lowest bit set above the piece's length.

Scale. Texts are encoded once and written as pieces; packing moves (piece number, length)
alone. A partition holds about ``PART`` pieces whatever the size of the corpus or the
form of its lengths, as pieces are dealt by a hash of their number. Placements meet
the ids again in one join on the piece number.

Defined results. Null and empty texts are one piece that holds the end id. Rows with a null or repeated doc_id are
packed like any others, each row a document. Equal lengths go by piece number, so a repeated run of the same written
pieces gives the same sequences; numbers of sequences carry no meaning. Other columns of the input do not matter. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import materialise, small_batches, text_or_empty
from subjex.llm.token_shards import encoder

PART, ROUNDS = 200_000, 6
PIECES = "doc_id long, piece int, start long, length int, ids binary"
#: Sequence numbers: the round in the upper bits, then the partition, then the sequence within it.
ROUND_BITS, WITHIN_BITS = 56, 24


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids as little-endian unsigned 32-bit): every document's ids cut at ``size``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, out = b.column("doc_id").to_pylist(), []
            for doc_id, ids in zip(own, encoder(tokenizer).encode(b.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out += [(doc_id, k, at, min(size, len(ids) - at), ids[at:at + size].tobytes()) for k, at in enumerate(range(0, len(ids), size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                             names=["doc_id", "piece", "start", "length", "ids"])
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the sequence that each piece goes to and its place there, by best-fit decreasing; equal lengths in the given order."""
    piles: list[list[int]] = [[] for _ in range(size + 1)]
    free, used = 0, 0  # bit f of ``free``: a sequence with f places left is open
    out, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            pile = piles[f]
            s = pile.pop()
            if not pile:
                free &= ~(1 << f)
        else:
            f, s, used = size, used, used + 1
        out[i], at[i] = s, size - f
        left = f - n
        if left:
            if not piles[left]:
                free |= 1 << left
            piles[left].append(s)
    return out, at


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest of several dual feasible bounds on the number of sequences of ``size``; in whole numbers throughout."""
    n, count = np.unique(lengths, return_counts=True)
    if not len(n):
        return 0
    n, count = n.astype(np.int64), count.astype(np.int64)
    total = lambda values: int((values * count).sum())
    up = lambda a, b: -(-a // b)
    bounds = [up(total(n), size)]
    for k in range(1, 101):  # u(k): shares in steps of 1/k, scaled by k * size
        x = (k + 1) * n
        bounds.append(up(total(np.where(x % size == 0, k * n, x // size * size)), k * size))
    for e in [int(v) for v in n if 2 * v <= size]:
        # large pieces count whole, those under e not at all
        kept = np.where(n > size - e, size, np.where(n >= e, n, 0))
        bounds.append(up(total(kept), size))
        # pieces over half leave room for a number of pieces of e, pieces from e to half count one place of that number
        places = size // e
        half = np.where(2 * n > size, 2 * (places - (size - n) // e), np.where(2 * n == size, places, np.where(n >= e, 2, 0)))
        bounds.append(up(total(half), 2 * places))
    return max(bounds)


PACKED = "id long, length int, sequence long, offset long, filled int, certified boolean"


def pack_round(items: DataFrame, size: int, parts: int, number: int) -> DataFrame:
    """(id, length, sequence, offset, filled, certified) of ``items`` (id, length), packed within ``parts`` partitions dealt by hash."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        lengths = t.column("length").to_numpy().astype(np.int64)
        own, at = best_fit(lengths, size)
        used = int(own.max()) + 1
        filled = np.bincount(own, weights=lengths, minlength=used).astype(np.int32)
        base = (number << ROUND_BITS) + (int(t.column("part")[0].as_py()) << WITHIN_BITS)
        certified = used == lower_bound(lengths, size)
        return pa.table([t.column("id"), t.column("length"), pa.array(base + own, pa.int64()), pa.array(at, pa.int64()), pa.array(filled[own], pa.int32()), pa.array(np.full(len(own), certified))],
                        names=["id", "length", "sequence", "offset", "filled", "certified"])
    part = F.pmod(F.xxhash64(F.lit(number), "id"), F.lit(parts)).cast("int")
    return items.select("id", "length", part.alias("part")).groupBy("part").applyInArrow(run, PACKED)


def place(items: DataFrame, size: int, part: int = PART, rounds: int = ROUNDS) -> tuple[DataFrame, list[dict]]:
    """(id, sequence, offset) of ``items`` (id, length, shorter than ``size``), and each round's figures: pieces, partitions,
    certified partitions, sequences, and whether it was kept."""
    spark, report = items.sparkSession, []
    placed = ["id", "sequence", "offset"]
    done = items.select("id", *(F.lit(0).cast("long").alias(c) for c in placed[1:])).limit(0)
    before = None  # sequences that the pieces of this round held until now
    held = None    # and where
    for number in range(1, rounds + 1):
        n = items.count()
        if not n:
            break
        parts = math.ceil(n / part)
        packed = materialise(pack_round(items, size, parts, number), "packed")
        per = packed.groupBy("sequence").agg(F.first("filled").alias("filled"), F.first("certified").alias("certified"))
        per = per.withColumn("part", F.shiftright("sequence", WITHIN_BITS))
        figures = per.agg(F.count("*"), F.countDistinct("part"), F.countDistinct(F.when(F.col("certified"), F.col("part")))).first()
        report.append({"pieces": n, "partitions": figures[1], "certified": figures[2], "sequences": figures[0], "kept": before is None or figures[0] < before})
        if not report[-1]["kept"]:
            break
        if parts == 1 and figures[2] == 1:
            return done.unionByName(packed.select(placed)), report
        emptiest = per.where("certified").groupBy("part").agg(F.min_by("sequence", F.struct("filled", "sequence")).alias("sequence")).select("sequence")
        again = per.where(~F.col("certified") & (F.col("filled") < size)).select("sequence").unionByName(emptiest)
        given = materialise(packed.join(again, "sequence", "left_semi"), "given-back")
        done = done.unionByName(packed.join(again, "sequence", "left_anti").select(placed))
        items, held = given.select("id", "length"), given.select(placed)
        before = given.select("sequence").distinct().count()
    return (done if held is None else done.unionByName(held)), report


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of all pieces of ``docs`` (doc_id, text)."""
    cut = materialise(pieces(docs, tokenizer, end_id, size).withColumn("id", F.monotonically_increasing_id()), "pieces")
    placed, _ = place(cut.where(F.col("length") < size).select("id", "length"), size, part, rounds)
    inside = placed.select("id", F.col("sequence").alias("sequence_id"), "offset")
    # a full piece is a sequence of its own: negative numbers are free
    full = cut.where(F.col("length") == size).withColumn("sequence_id", -F.col("id") - 1).withColumn("offset", F.lit(0).cast("long"))
    cols = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    return full.select(cols).unionByName(cut.where(F.col("length") < size).join(inside, "id").select(cols))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of every sequence, its pieces behind each other."""
    p = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(p.alias("p")).select("sequence_id", F.expr("aggregate(transform(p, x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"))
