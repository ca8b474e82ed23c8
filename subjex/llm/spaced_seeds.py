"""Benchmark decontamination by spaced-seed hashing.

Method. A seed is a mask over a few consecutive words: hashed positions count,
the others are free to differ. Every window of every benchmark item is hashed
under each mask; the hashes of the documents' windows meet them. Around each
hit the document and the item are laid side by side, word by word: an overlap is a
stretch of ``WINDOW`` words with at most ``SUBSTITUTIONS`` different. The three
masks together hit every such stretch (tested over all cases). Items shorter
than ``WINDOW`` words must occur whole, with one word in ``SHORT_RATE`` different; two masks, one for
each half of such an item, hit it however that word lies. Items under ``SHORTEST`` words are
phrases, not passages, and are not searched for.

Bounds. The index goes to the executors in slices of about ``slice_mb`` of
benchmark text; documents pass once per slice, so a benchmark of any size
is searched whole with one slice in memory, also on the driver. Equal items are searched for once.
Hits are expanded in blocks of ``BLOCK``.

Defined results. Null or empty text has no overlap. Words are runs of letters
and digits, lower-cased; punctuation, symbols and spaces of any script part them, and characters of
scripts that write without spaces are words of their own. Rows that repeat a doc_id are searched one by one.
An empty benchmark matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjex.llm.common import materialise, small_batches, text_or_empty
from subjex.llm.words import _random_odd, mix, word_hashes

WINDOW, SUBSTITUTIONS, SHORTEST, SHORT_RATE = 12, 2, 5, 6
#: Beyond ASCII: what parts words, and scripts whose characters stand alone.
_PARTING = r"[\p{P}\p{S}\p{Z}\p{Cc}&&[^\x00-\x7F]]"
_ALONE = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5))
BLOCK, FILTER_BITS = 1 << 18, 22
FOUND = "doc_id long, n_items long, best_item long, best_words long"


def _spaced(text: Column) -> Column:
    """Lower-cased text whose words are runs of letters and digits between ASCII characters. Texts in ASCII stay as they are."""
    parted = F.regexp_replace(F.regexp_replace(F.lower(text), _PARTING, " "), _ALONE, " $1 ")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(parted)


def _allowed(size: int) -> int:
    """Words of a window that may differ: of a whole item where it is shorter than WINDOW."""
    return SUBSTITUTIONS if size >= WINDOW else size // SHORT_RATE


def _seed(words: np.ndarray, mask: tuple[int, ...], name: int) -> np.ndarray:
    """The hash under ``mask`` of the window at each word."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p, factor in zip(mask, _random_odd(1000 + name, len(mask))):
        out += words[p:p + n] * factor
    return mix(out)


class Index:
    """Seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.words, self.at = word_hashes(pa.array(texts, pa.string()))
        size = np.diff(self.at)
        # halves of short items: masks without gaps, named by their length
        halves = sorted({h for n in range(SHORTEST, WINDOW) if (size == n).any() for h in (n // 2, n - n // 2)})
        self.masks = [*MASKS, *(tuple(range(h)) for h in halves)]
        rows = [np.zeros((0, 3), np.int64)]
        for name, mask in enumerate(self.masks):
            seeds = _seed(self.words, mask, name).view(np.int64)
            place = np.arange(len(seeds))
            item = np.searchsorted(self.at, place, side="right") - 1
            n, inside = size[item], place - self.at[item]
            fits = place + mask[-1] < self.at[item + 1]
            if name < len(MASKS):
                fits &= n >= WINDOW
            else:
                first, second = n // 2, n - n // 2
                fits &= (n >= SHORTEST) & (n < WINDOW) & (((first == len(mask)) & (inside == 0)) | ((second == len(mask)) & (inside == first)))
            rows.append(np.stack([seeds[fits], item[fits], inside[fits]], 1))
        rows = np.concatenate(rows)
        rows = rows[np.argsort(rows[:, 0].view(np.uint64), kind="stable")]
        self.seeds, self.item, self.place = rows[:, 0].copy().view(np.uint64), rows[:, 1], rows[:, 2]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._low(self.seeds)] = True

    @staticmethod
    def _low(seeds: np.ndarray) -> np.ndarray:
        return (seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def overlaps(self, col: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text of the column, item, first word in the text, words, equal words) of every overlap."""
        words, at = word_hashes(col)
        found: set[tuple[int, int, int]] = set()
        for name, mask in enumerate(self.masks):
            seeds = _seed(words, mask, name)
            place = np.flatnonzero(self.filter[self._low(seeds)])
            lo, hi = (np.searchsorted(self.seeds, seeds[place], side=s) for s in ("left", "right"))
            doc = np.searchsorted(at, place, side="right") - 1
            real = (hi > lo) & (place + mask[-1] < at[doc + 1])
            place, doc, lo, n = place[real], doc[real], lo[real], (hi - lo)[real]
            cuts = np.searchsorted(np.cumsum(n), np.arange(BLOCK, int(n.sum()) + BLOCK, BLOCK))
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
                if b > a:
                    m = n[a:b]
                    entry = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    diagonal = np.repeat(place[a:b] - at[doc[a:b]], m) - self.place[entry]
                    found.update(map(tuple, np.unique(np.stack([np.repeat(doc[a:b], m), self.item[entry], diagonal], 1), axis=0).tolist()))
        out = []
        for d, item, diagonal in sorted(found):
            got = _overlap(words[at[d]:at[d + 1]], self.words[self.at[item]:self.at[item + 1]], diagonal)
            if got:
                out.append((d, int(self.ids[item]), *got))
        return out


def _overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first word in the text, words, equal words) of the agreeing windows on one diagonal."""
    a, b = max(0, -diagonal), min(len(item), len(text) - diagonal)
    size = min(WINDOW, len(item))
    if b - a < size:
        return None
    equal = text[a + diagonal:b + diagonal] == item[a:b]
    upto = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(upto[size:] - upto[:-size] >= size - _allowed(size))
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + size
    return a + diagonal + first, last - first, int(equal[first:last].sum())


def slices(benchmark: DataFrame, slice_mb: float) -> tuple[int, Iterator]:
    """Number of slices, and broadcast indexes over the distinct items, one after the other: the next one is read when it is asked
    for, and the last one is given up then. Items go by the smallest item_id of their text."""
    spark = benchmark.sparkSession
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), _spaced(text_or_empty()).alias("text")).where("item_id is not null")
             .groupBy("text").agg(F.min("item_id").alias("item_id")))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // max(1, int(slice_mb * (1 << 20)))))

    def each() -> Iterator:
        before = None
        for k in range(n):
            if before is not None:
                before.unpersist()
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id").collect()  # about slice_mb
            before = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
            yield before
    return n, each()


_OPEN: dict = {}


def _index(shared) -> Index:
    """Built once per Python worker; only the latest slice is kept."""
    if shared.value is not _OPEN.get("of"):
        _OPEN.update(of=shared.value, index=Index(*shared.value))
    return _OPEN["index"]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, slice_mb: float = 4) -> DataFrame:
    """(doc_id, n_items, best_item, best_words) of every row: benchmark items it overlaps with, and the one with most equal words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _spaced(text_or_empty()).alias("text"))
    n, every = slices(benchmark, slice_mb)
    if n > 1:  # each row has a key of its own, written once: rows may share a doc_id or have none
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "keyed-rows")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for b in batches:
                best: list[dict] = [{} for _ in range(b.num_rows)]
                for d, item, _, _, equal in index.overlaps(b.column("text")):
                    best[d][item] = max(equal, best[d].get(item, 0))
                top = [max(((w, -i) for i, w in x.items()), default=None) for x in best]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, best), pa.int64()), pa.array([-t[1] if t else None for t in top], pa.int64()),
                                                  pa.array([t[0] if t else 0 for t in top], pa.int64()), b.column("row")], names=["doc_id", "n_items", "best_item", "best_words", "row"])
        return run

    if n == 1:
        return rows.mapInArrow(search(next(every)), f"{FOUND}, row long").drop("row")
    # one slice after the other: what it finds is written before the next one is read
    out = rows.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_items", "best_item", "best_words")), "row")
    for s in every:
        out = out.unionByName(materialise(rows.mapInArrow(search(s), f"{FOUND}, row long").where("n_items > 0"), "slice-hits"))
    best = F.max(F.when(F.col("n_items") > 0, F.struct("best_words", (-F.col("best_item")).alias("minus"))))
    return (out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_items").alias("n_items"), best.alias("b"))
            .select("doc_id", "n_items", (-F.col("b.minus")).alias("best_item"), F.coalesce("b.best_words", F.lit(0)).alias("best_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, slice_mb: float = 4) -> DataFrame:
    """The rows of ``docs`` without any overlap, all their columns as they are."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    lower = next(n for n in (f"_lower{'_' * k}" for k in range(99)) if n not in columns)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[d for d, *_ in index.overlaps(b.column(lower))]] = False
                yield b.select(columns).filter(pa.array(clean))
        return run

    n, every = slices(benchmark, slice_mb)
    for k, s in enumerate(every):
        docs = docs.withColumn(lower, _spaced(text_or_empty())).mapInArrow(search(s), docs.schema)
        docs = materialise(docs, "decontaminated") if k + 1 < n else docs
    return docs
