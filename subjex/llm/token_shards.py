"""Token-ID output: id arrays compressed document by document with a shared zstandard dictionary.

Method. Documents are dealt by ranges of doc_id and sorted inside each range.
Tasks encode whole texts, compress every document's ids as its own zstandard
frame with one dictionary trained on serialized id arrays, and write blocks: a
row holds the frames of some consecutive documents, the offset of each frame,
the ids before the block within its shard, and the hash of the dictionary. A
manifest holds the ids before each shard. A reader finds one short document by
doc_id range and offset and decompresses only its frame.

Layout below ``path``: ``dictionary`` (one row), ``blocks``, ``manifest`` (a
row per shard). Files go through Spark's writer, so any store it can write
will do and a lost executor's tasks are repeated without traces.

Bounds. A shard holds about ``SHARD_BYTES`` of text at most, by the measured size of all texts. The dictionary is fit on the ``sample_docs`` documents of smallest
doc_id hash, at most ``SAMPLE_IDS`` ids of each. A block holds one Arrow
batch. Encoded pieces are remembered up to ``ChunkEncoder.MOST``.

Defined results. Ids are those of the library's plain call without its added special tokens: the content of
an added token that stands in a text is that token's id. Null and empty texts hold the end id alone. Null doc_ids come
first; rows that repeat a doc_id keep one place each, ordered by a text hash.
Other columns of the input do not matter, whatever their names. An empty table gives no blocks.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subjex.llm.common import shared_path, small_batches, text_or_empty
from subjex.llm.words import SEGMENT, buffers, byte_classes, hash_runs

SAMPLE_IDS = 1 << 16
#: Text encoded into one shard.
SHARD_BYTES = 128 << 20
BLOCKS = ("shard int, block int, first_doc long, last_doc long, dict_hash string, width int, shard_start long, total long, "
          "doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary")
DOCS = "doc_id long, start long, n_tokens long, ids binary"

#: Bytes after a space that surely begin a new piece: visible ASCII and the lead bytes of letters; not
#: those that may begin a white-space character.
_SAFE = byte_classes((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))


class ChunkEncoder:
    """The tokenizer's ids of whole texts, each distinct space-led chunk encoded once.

    Byte-level pieces never reach over a space that precedes a visible
    character, so a text's ids are the ids of its chunks in turn. Chunks are
    told apart by length and 64-bit hash; unknown ones are encoded together.
    Known chunks lie in two sorted tables, a large one and one of late
    arrivals that is merged into it now and then.
    """

    MOST, LATE = 2_000_000, 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # contents of added tokens are ids of their own wherever they stand, the longest one first
        added = sorted(self.tokenizer.get_added_tokens_decoder().items(), key=lambda t: -len(t[1].content))
        self.added = {t.content: i for i, t in added}
        #: added tokens that take neighbouring spaces or depend on what is beside them are left to the library
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added)
        self._forget()

    def _forget(self):
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # hash, first id, ids
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column without nulls."""
        held = np.zeros(len(col), bool)
        for content in self.added:
            held |= pc.match_substring(col, content).to_numpy(zero_copy_only=False)
        if not held.any():
            return self._encode(col)
        out: list = [None] * len(col)
        for i, ids in zip(np.flatnonzero(~held).tolist(), self._encode(col.filter(pa.array(~held)))):
            out[i] = ids
        for i in np.flatnonzero(held).tolist():
            out[i] = self._with_added(col[i].as_py())
        return out

    def _with_added(self, text: str) -> np.ndarray:
        """Ids of a text that holds contents of added tokens: what stands between them is encoded as texts of their own."""
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = re.split("(" + "|".join(map(re.escape, self.added)) + ")", text)
        between = self._encode(pa.array(parts[::2], pa.string()))
        marks = [np.array([self.added[p]], np.uint32) for p in parts[1::2]]
        return np.concatenate([x for pair in zip(between, [*marks, np.zeros(0, np.uint32)]) for x in pair])

    def _encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        data, offsets = buffers(col)
        ids, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end:
            hi = self._cut(data, offsets, lo, min(lo + SEGMENT, end))
            seg = data[lo:hi]
            first = np.zeros(len(seg), bool)
            first[:-1] = (seg[:-1] == 32) & _SAFE[seg[1:]]
            begin = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
            first[begin[begin > 0] - 1] = False  # a space that ends a text leads nothing
            first[begin] = first[0] = True
            starts = np.flatnonzero(first)
            at, n = self._known(seg, starts)
            ends = np.cumsum(n)
            ids.append(self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1])])
            places.append(np.repeat(starts + lo, n))
            lo = hi
        flat, cut = np.concatenate(ids), np.searchsorted(np.concatenate(places), offsets)
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> int:
        """The last text end up to ``hi``; inside a longer text, the last chunk start."""
        at = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
        if at > lo:
            return at
        stop = int(offsets[np.searchsorted(offsets, lo, side="right")])
        while hi < stop:
            safe = np.flatnonzero((data[lo + 1:hi] == 32) & _SAFE[data[lo + 2:hi + 1]])
            if len(safe):
                return lo + 1 + int(safe[-1])
            hi = min(hi + SEGMENT, stop)
        return stop

    def _known(self, seg: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of every chunk."""
        ends = np.append(starts[1:], len(seg))
        hashes = hash_runs(seg, starts, np.ones(len(seg), bool)) + (ends - starts).astype(np.uint64)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, n, found = self._look(distinct)
        if not found.all():
            if len(self.tables[0][0]) + len(distinct) > self.MOST:
                self._forget()
                found[:] = False
            new, raw = where[~found], seg.tobytes()
            begin, stop = starts[new], ends[new]
            led = (seg[begin] == 32) & (stop - begin > 1)
            led[led] = _SAFE[seg[begin[led] + 1]]
            self._learn(distinct[~found], [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), stop.tolist())], led)
            at, n, found = self._look(distinct)
        back = back.reshape(-1)
        return at[back], n[back]

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, n, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for own, start, size in self.tables:
            if len(own):
                i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[i] == keys
                at[hit], n[hit] = start[i[hit]], size[i[hit]]
                found |= hit
        return at, n, found

    def _learn(self, keys: np.ndarray, chunks: list[str], led: np.ndarray) -> None:
        """Encode new chunks: those led by a safe space many at a time, told apart by character offsets."""
        encode = functools.partial(self.tokenizer.encode, add_special_tokens=False)
        found: list = [None] * len(chunks)
        for i in np.flatnonzero(~led).tolist():
            found[i] = np.array(encode(chunks[i]).ids, np.uint32)
        todo = np.flatnonzero(led)
        for part in np.array_split(todo, max(1, len(todo) // 2000)) if len(todo) else []:
            texts = [chunks[i] for i in part.tolist()]
            e = encode("".join(texts))
            begins = np.cumsum([0, *map(len, texts)])
            of = np.searchsorted(begins, np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids)), side="right") - 1
            ids, cut = np.array(e.ids, np.uint32), np.searchsorted(of, np.arange(len(part) + 1))
            for k, i in enumerate(part.tolist()):
                found[i] = ids[cut[k]:cut[k + 1]]
        size = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found)
        start = self.filled + np.cumsum(size) - size
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.filled:self.filled + len(flat)] = flat
        self.filled += len(flat)
        main, late = self.tables
        late = self._merged(late, (keys, start, size))
        self.tables = [self._merged(main, late), tuple(x[:0] for x in late)] if len(late[0]) > self.LATE else [main, late]

    @staticmethod
    def _merged(old: tuple, new: tuple) -> tuple:
        at = np.searchsorted(old[0], new[0])
        return tuple(np.insert(a, at, b) for a, b in zip(old, new))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, kept from task to task."""
    return ChunkEncoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, sample_docs: int, dict_bytes: int) -> bytes:
    """A dictionary fit in one task on a bounded sample; empty where there is nothing to learn from."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # one text for each of at most sample_docs ids, however often an id repeats
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text").coalesce(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for b in batches for x in encoder(tokenizer).encode(b.column("text"))]
        try:
            made = zstandard.train_dictionary(dict_bytes, rows).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few samples: their own bytes serve as content
            made = b"".join(rows)[-dict_bytes:]
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    got = sample.mapInArrow(train, "dictionary binary").collect()
    return bytes(got[0][0]) if got else b""


def _dict(data: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if len(data) >= 8 else {}


def dict_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int = 50_257,
          sample_docs: int = 1000, dict_bytes: int = 1 << 16) -> None:
    """Encode ``docs`` (doc_id, text) and write dictionary, blocks and manifest below ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    data = train_dictionary(docs, tokenizer, width, sample_docs, dict_bytes)
    shared, name = spark.sparkContext.broadcast(data), dict_hash(data)
    spark.createDataFrame([(name, width, data)], "dict_hash string, width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        compress = zstandard.ZstdCompressor(level=3, write_content_size=True, **_dict(shared.value)).compress
        for k, b in enumerate(batches):
            if not b.num_rows:
                continue
            ids = [np.append(x, np.uint32(end_id)) for x in encoder(tokenizer).encode(b.column("text"))]
            frames = [compress(x.astype(f"<u{width}").tobytes()) for x in ids]
            own, n = b.column("doc_id").to_pylist(), [len(x) for x in ids]
            row = {"shard": shard, "block": k, "first_doc": next((d for d in own if d is not None), None), "last_doc": own[-1], "dict_hash": name, "width": width,
                   "shard_start": before, "total": sum(n), "doc_ids": own, "n_tokens": n,
                   "offsets": np.cumsum([0, *map(len, frames)]).tolist(), "payload": b"".join(frames)}
            before += sum(n)
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_TYPE)

    order = ["doc_id", F.xxhash64("text")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-int(size) // SHARD_BYTES)
    ranges = [shards] if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else []  # the session's number where it is enough
    sorted_docs = docs.repartitionByRange(*ranges, *order).sortWithinPartitions(*order)
    sorted_docs.mapInArrow(pack, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("total").alias("total"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    totals.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("start"), "total").coalesce(1).write.parquet(f"{path}/manifest")


_BLOCK_TYPE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_hash", pa.string()),
                         ("width", pa.int32()), ("shard_start", pa.int64()), ("total", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                         ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())])


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "start")
    return spark.read.parquet(f"{path}/blocks").join(F.broadcast(manifest), "shard")  # a row per shard


def _opener(spark: SparkSession, path: str):
    """A function from a block's row to its decompressor; refuses a block of another dictionary."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((row["dict_hash"], bytes(row["dictionary"])))

    def open_block(named: str):
        if named != shared.value[0] or dict_hash(shared.value[1]) != named:
            raise ValueError(f"block needs dictionary {named}, found {shared.value[0]}")
        return zstandard.ZstdDecompressor(**_dict(shared.value[1])).decompress
    return open_block


def read(spark: SparkSession, path: str, only: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit) of all documents or of one;
    for one, only the blocks whose range holds it are read and only its frame is decompressed."""
    blocks, open_block = _blocks(spark, path), _opener(spark, path)
    if only is not None:
        blocks = blocks.where((F.col("first_doc") <= only) & (F.col("last_doc") >= only))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                decompress = open_block(r["dict_hash"])
                starts = r["start"] + r["shard_start"] + np.cumsum([0, *r["n_tokens"]])
                pick = [i for i, d in enumerate(r["doc_ids"]) if only is None or d == only]
                cut = r["offsets"]
                ids = [np.frombuffer(decompress(r["payload"][cut[i]:cut[i + 1]]), f"<u{r['width']}").astype("<u4") for i in pick]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][i] for i in pick], pa.int64()), pa.array([int(starts[i]) for i in pick], pa.int64()),
                                                  pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(unpack, DOCS)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-shards")
    write(docs, path, tokenizer, end_id)
    return read(spark, path)
