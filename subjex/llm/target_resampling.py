"""Importance resampling towards a target text, with the features of repeated lines computed once.

Method. A text's features are its runs of one to three consecutive words, each
hashed into a bucket. Newlines separate words, so a text is a sequence of lines:
its features are those inside each line and those that cross a line's end. Equal
lines are collapsed first. The buckets of every distinct line are computed
once and written with its number of occurrences; those that cross line ends
are computed per document and written beside it. Corpus counts are the sums of
both, lines times their occurrences. A bucket's gain is the logarithm of its
share in the target over its share in the corpus; a document's weight is the sum
over its lines (joined by line) and its crossing features. Gumbel noise from a
hash of the doc_id makes the highest scores a sample without replacement.

Hashing. A feature's crc32 follows from those of its words: the crc of a
concatenation is the first one's, shifted by the second's length, xor the
second's. So no feature is ever written out as a string, and all work runs on
whole Arrow columns.

Scale. Texts are read three times and never shuffled whole; distinct lines are
shuffled once, after partial counts. Line weights meet documents by a join on
128 bits of line hash. A line that makes up more than 1/``HOT`` of all is one of at most
``HOT`` lines and joins by broadcast, so no hot line lands in one task.
Counts reach the driver as one number per bucket. Ranks come from a range
sort and the number of rows in each of its partitions.

Defined results. Null and empty texts have no features, weight 0 and are never
drawn. A null doc_id hashes as the empty string and comes first among ties. Rows
that repeat doc_id and text get equal weights and scores and ranks of their own.
Ties in the score go to the smaller doc_id, then to the smaller text hash. Other columns
of the input do not matter, whatever their names. An empty table gives no rows; an empty target has a share of
one in every bucket. Documents have the weight's exact integers, however the rows are dealt out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjex.llm.common import materialise, small_batches, text_or_empty
from subjex.llm.words import LETTERS, buffers, segments

BUCKETS, LONGEST, HOT = 10_000, 3, 4096
#: Words at a time when features are formed.
STEP = 1 << 20
KEY = ["doc_id", "k1", "k2"]


def _crc_table() -> np.ndarray:
    """The byte table of crc32 (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHORT = 64


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Effect of n zero bytes on a crc, by byte of the crc: for n below ``_SHORT``, and for n = 2^k."""
    one = lambda v: (v >> np.uint32(8)) ^ _CRC[v & np.uint32(255)]
    at = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    short = [at]
    for _ in range(_SHORT - 1):
        short.append(one(short[-1]))
    powers = [one(at)]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0, v & np.uint32(255)] ^ table[1, (v >> np.uint32(8)) & np.uint32(255)] ^ table[2, (v >> np.uint32(16)) & np.uint32(255)] ^ table[3, v >> np.uint32(24)]


_BY_LENGTH, _BY_POWER = _shift_tables()
_FLAT = _BY_LENGTH.reshape(-1)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each crc after its number of zero bytes."""
    base = np.minimum(n, _SHORT - 1).astype(np.int64) * 1024
    out = (_FLAT[base + (crc & np.uint32(255))] ^ _FLAT[base + 256 + ((crc >> np.uint32(8)) & np.uint32(255))]
           ^ _FLAT[base + 512 + ((crc >> np.uint32(16)) & np.uint32(255))] ^ _FLAT[base + 768 + (crc >> np.uint32(24))])
    long = np.flatnonzero(n >= _SHORT)
    if len(long):
        v, left = crc[long], n[long].astype(np.int64)
        for k in range(int(left.max()).bit_length()):
            on = (left >> k) & 1 == 1
            v[on] = _apply(_BY_POWER[k], v[on])
        out[long] = v
    return out


def run_crcs(seg: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes."""
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        out[i] = zlib.crc32(seg[starts[i]:starts[i] + sizes[i]].tobytes())
    short = np.flatnonzero(sizes <= _SHORT)
    order = short[np.argsort(-sizes[short], kind="stable")]
    left, at = sizes[order], starts[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # runs longer than k come first
        crc[:n] = (crc[:n] >> np.uint32(8)) ^ _CRC[(crc[:n] ^ seg[at[:n] + k]) & np.uint32(255)]
    out[order] = ~crc
    return out


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and bytes of every word of a column, the line each lies in, and the word offsets of its texts."""
    data, offsets = buffers(col)
    crcs, sizes, lines, places = ([np.zeros(0, t)] for t in (np.uint32, np.int64, np.int64, np.int64))
    line = 0
    for lo, hi in segments(data, offsets, LETTERS):
        seg = _LOWER[data[lo:hi]]
        inner = LETTERS[seg]
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        begin = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        first[begin] = inner[begin]
        last[begin[begin > 0] - 1] = inner[begin[begin > 0] - 1]
        starts = np.flatnonzero(first)
        n = np.flatnonzero(last) + 1 - starts
        crcs.append(run_crcs(seg, starts, n))
        sizes.append(n)
        ends = np.flatnonzero(seg == 10)
        lines.append(line + np.searchsorted(ends, starts))
        line += len(ends)
        places.append(starts + lo)
    return np.concatenate(crcs), np.concatenate(sizes), np.concatenate(lines), np.searchsorted(np.concatenate(places), offsets)


def features(col: pa.Array, crossing: bool) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, and the buckets of its features as little-endian 16-bit numbers: all
    of them, or only those that cross a line's end."""
    crc, size, line, at = words(col)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
    found, owners = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for lo in range(0, len(crc), STEP):
        hi = min(lo + STEP, len(crc))
        run = crc[lo:hi]
        for k in range(LONGEST):
            stop = min(hi, len(crc) - k)
            if stop <= lo:
                break
            if k:
                run = shifted(run[:stop - lo], size[lo + k:stop + k] + 1) ^ spaced[lo + k:stop + k]
            inside = text[lo:stop] == text[lo + k:stop + k]
            if crossing:
                inside &= line[lo:stop] != line[lo + k:stop + k]
            found.append((run[inside] % BUCKETS).astype(np.uint16))
            owners.append(text[lo:stop][inside])
    owner = np.concatenate(owners)
    ordered = np.concatenate(found)[np.argsort(owner, kind="stable")].astype("<u2")
    ends = np.cumsum(np.append(0, np.bincount(owner, minlength=len(n)))) * 2
    return n, pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ordered)])


def _stored(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a written column, and the offsets of its rows."""
    col = col.cast(pa.large_binary())
    raw = col.buffers()
    ends = np.frombuffer(raw[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]].view("<u2"), (ends - ends[0]) // 2


def _hashes(c: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits of a string: two chains with seeds of their own."""
    return [F.xxhash64(F.lit(k), c).alias(name) for k, name in enumerate(names, 1)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", *_hashes(F.col("text"), ("k1", "k2")), "text")


def _featured(df: DataFrame, text: str, keep: str, crossing: bool) -> DataFrame:
    """The columns ``keep`` (a schema) of ``df``, n_words and buckets of its column ``text``."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, buckets = features(b.column(text), crossing)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), buckets.cast(pa.binary())], names=[*names, "n_words", "buckets"])
    return df.mapInArrow(run, f"{keep}, n_words long, buckets binary")


def lines_of(texts: DataFrame) -> DataFrame:
    return texts.select(*KEY, F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


def featured_lines(texts: DataFrame) -> DataFrame:
    """(h1, h2, times, n_words, buckets) of every distinct line."""
    distinct = lines_of(texts).groupBy("line").agg(F.count("*").alias("times")).select(*_hashes(F.col("line"), ("h1", "h2")), "times", "line")
    return _featured(distinct, "line", "h1 long, h2 long, times long", False)


def featured_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, buckets) of every row: the buckets are of the features across line ends."""
    return _featured(texts, "text", "doc_id long, k1 long, k2 long", True)


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """Features in each bucket, from (times, buckets); one row per bucket and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            found, ends = _stored(b.column("buckets"))
            times = np.repeat(b.column("times").to_numpy(), np.diff(ends))
            total += np.rint(np.bincount(found, weights=times, minlength=BUCKETS)).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])
    sums = rows.select("times", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in sums.collect()}  # BUCKETS rows at most


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the corpus."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + BUCKETS) / (float(corpus.get(b, 0) + 1) * float(t_all + BUCKETS))))
                     for b in range(BUCKETS)], np.int64)


def _weighed(df: DataFrame, keep: str, shared) -> DataFrame:
    """``keep`` (a schema), n_words and the summed gains of each row's buckets."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, ends = _stored(b.column("buckets"))
            upto = np.append(0, np.cumsum(shared.value[found]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*names, "n_words")), pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())], names=[*names, "n_words", "w"])
    return df.mapInArrow(run, f"{keep}, n_words long, w long")


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_words, n_features, weight) of every row of ``docs`` (doc_id, text) towards the texts
    of ``target`` (text); k1 and k2 hash the text."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs)
    rows = materialise(featured_texts(texts), "crossing-features")
    lines = materialise(featured_lines(texts), "line-features")
    goal = _texts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    goal = materialise(featured_lines(goal).select("times", "buckets").unionByName(featured_texts(goal).select(F.lit(1).cast("long").alias("times"), "buckets")), "target-features")
    corpus = lines.select("times", "buckets").unionByName(rows.select(F.lit(1).cast("long").alias("times"), "buckets"))
    shared = spark.sparkContext.broadcast(gains(bucket_counts(corpus), bucket_counts(goal)))

    of_line = materialise(_weighed(lines, "h1 long, h2 long, times long", shared).select("h1", "h2", "times", "w"), "line-weights")
    total = of_line.agg(F.sum("times")).first()[0] or 0
    often = of_line.where(F.col("times") * HOT > total)  # fewer than HOT lines can be that frequent
    hot = F.broadcast(often.select("h1", "h2", F.col("w").alias("hot_w")))
    links = lines_of(texts).select(*KEY, *_hashes(F.col("line"), ("h1", "h2"))).join(hot, ["h1", "h2"], "left")
    # a hot line's weight is known: its link goes on under the document's hash and matches nothing
    known = F.col("hot_w").isNotNull()
    links = links.select(*KEY, "hot_w", F.when(known, F.col("k1")).otherwise(F.col("h1")).alias("h1"), F.when(~known, F.col("h2")).alias("h2"))
    rare = of_line.where(F.col("times") * HOT <= total).select("h1", "h2", "w")
    per_line = links.join(rare, ["h1", "h2"], "left").select(*KEY, F.coalesce("hot_w", "w").alias("w"), F.lit(0).alias("rows"))
    crossing = materialise(_weighed(rows, "doc_id long, k1 long, k2 long", shared), "crossing-weights")
    # rows that repeat id and text sent their lines once each: their sum is shared out
    sums = (per_line.unionByName(crossing.select(*KEY, F.lit(0).cast("long").alias("w"), F.lit(1).alias("rows")))
            .groupBy(*KEY).agg(F.sum("w").alias("line_w"), F.sum("rows").alias("rows")).select(*(F.col(c).alias(f"_{c}") for c in KEY), F.expr("line_w div rows").alias("line_w")))
    same = F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))
    n = F.col("n_words")
    n_features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, LONGEST)), n)
    return crossing.join(sums, same).select(*KEY, "n_words", n_features.cast("long").alias("n_features"), (F.col("w") + F.col("line_w")).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Adds score, and the rank of the ``percent`` of the rows of ``min_words`` words with the highest scores."""
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= min_words)
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("k1"), F.col("k2")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts the rows of each partition from 0, with the partition in its upper bits
    dealt = materialise(dealt.withColumn("place", F.monotonically_increasing_id()), "sorted-scores")
    part = F.shiftright("place", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    drawn = (dealt.agg(F.count_if("fit")).first()[0] or 0) * percent // 100
    rank = F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1
    ranked = dealt.withColumn("part", part).join(F.broadcast(starts), "part")
    return ranked.select(*weighed.columns, "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn rows of ``docs``; rows that repeat doc_id and text are taken together."""
    drawn = draw(weigh(docs, target), percent, min_words, seed).where("rank is not null").select(F.struct(*KEY).alias("__drawn")).distinct()
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(text_or_empty(), ("k1", "k2")))
    return docs.join(drawn, own.eqNullSafe(F.col("__drawn")), "left_semi")
