"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Method. A text is its sequence of word ``SHINGLE``-grams, each labelled with its
occurrence number, so every element is unique within the text. Each of
several hash orders picks the smallest elements and keeps them in text order; the
hash of that tuple is a bucket key. Two texts share a bucket only if the
picked elements agree in order as well as in kind, which follows edit
similarity rather than set overlap. Texts of ``LONG`` elements and more have
``SKETCHES`` keys of ``PICK`` elements, texts under ``SHORT`` have
``SHORT_SKETCHES`` keys of ``SHORT_PICK``; the ranges overlap so that texts
within the similarity always have one kind in common.

Candidates. Exact copies (equal word sequences) collapse first; only one
representative goes on. Each bucket has a hub, the member that shares most
buckets with others, and every member is compared with it: n - 1 comparisons
for n members. Buckets that still span several classes are then compared
whole: every member outside the bucket's largest class with every member of
another class. Where more than a block of words is outside it (unrelated texts with a common
footer, say), the members first go to buckets of their rarest elements, of which two similar
texts always share one. That runs inside tasks over blocks of about ``BLOCK`` words, where
postings count the elements two texts have in common; pairs whose count cannot
reach the similarity are dropped, which loses nothing, and the others are aligned.
So two texts that share a bucket and reach the similarity are always in one class.

Verification aligns two element sequences: common elements within the band of
diagonals that the similarity allows, longest chain increasing in both. The
similarity is chain / (n + m - chain); at ``similarity`` or more the two link.
The band loses nothing, as leaving it would cost more unmatched elements than
allowed. Classes are the connected components of the links.

Scale. Sketches (not texts) are shuffled for all documents; texts once, to
find those in shared buckets. Hub joins are skew-splittable equi-joins on
representatives. No pair of the second comparison becomes a row, only links do;
a bucket over several blocks sends each block to as many tasks as its members
outside the largest class fill blocks. Nothing is collected.

Defined results. Texts are lower-cased; words are runs of letters and digits.
Null, empty and wordless texts are their own classes. Texts under ``SHINGLE``
words match exact copies only. Rows that repeat a doc_id are classed text by text: each
has a row with its own text's class, and ``keep_one`` keeps the row of smallest doc_id of
each class (of smallest text hash among rows of one doc_id), so no text disappears because of another of the
same doc_id. Rows with a null doc_id have no row in the result; ``keep_one`` keeps them. Extra columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subjex.llm.common import materialise, small_batches, text_or_empty
from subjex.llm.components import components
from subjex.llm.words import _random_odd, mix, windows, word_hashes

SHINGLE = 5
LONG, SKETCHES, PICK = 32, 40, 8
SHORT, SHORT_SKETCHES, SHORT_PICK = 50, 10, 2
BLOCK = 1 << 19
SKETCHED = "doc_id long, h long, n long, fp1 long, fp2 long, few array<long>, many array<long>"
LINKED = "a long, b long, similar double"
_OCCURRENCE = np.uint64(0xD1B54A32D192ED03)


def elements(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingle hashes of one text's word hashes, in text order."""
    s = windows(words, SHINGLE)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.ones(len(s), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return s
    run = np.flatnonzero(new)
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))).astype(np.uint64)
    return np.where(nth > 0, mix(s + nth * _OCCURRENCE), s)


def sketch(s: np.ndarray, sketches: int, pick: int) -> np.ndarray:
    """One bucket key per hash order."""
    salt, factor, weight = _random_odd(21 + pick, sketches), _random_odd(51 + pick, sketches), _random_odd(81, pick)
    k = min(pick, len(s))
    rows = max(1, (1 << 18) // len(s))
    chosen = []
    for i in range(0, sketches, rows):  # a few megabytes at a time, also for a very long text
        v = (s[None, :] ^ salt[i:i + rows, None]) * factor[i:i + rows, None]
        v ^= v >> np.uint64(32)
        chosen.append(np.sort(np.argpartition(v, k - 1, axis=1)[:, :k], axis=1) if len(s) > k else np.broadcast_to(np.arange(k), v.shape))
    return mix((s[np.concatenate(chosen)] * weight[None, :k]).sum(1, dtype=np.uint64) + salt)


def sketch_pair(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys for short and for long texts; empty where a text is neither."""
    none = np.zeros(0, np.uint64)
    return (sketch(s, SHORT_SKETCHES, SHORT_PICK) if 0 < len(s) < SHORT else none), (sketch(s, SKETCHES, PICK) if len(s) >= LONG else none)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Longest common chain over union size, within the band that ``similarity`` allows."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m) - 1e-9:
        return 0.0
    order = np.argsort(a, kind="stable")
    at = np.minimum(np.searchsorted(a[order], b), n - 1)
    there = a[order][at] == b
    i, j = order[at[there]], np.flatnonzero(there)
    band = int((1 - similarity) / (1 + similarity) * (n + m)) + 1
    i = i[np.abs(i - j) <= band]
    if len(i) < similarity * (n + m - len(i)) - 1e-9:
        return 0.0
    chain = len(i) if np.all(i[1:] > i[:-1]) else _increasing(i.tolist())
    return chain / (n + m - chain)


def _increasing(places: list[int]) -> int:
    ends: list[int] = []
    for p in places:
        k = bisect_left(ends, p)
        ends[k:k + 1] = [p]
    return len(ends)


def _norm(docs: DataFrame) -> DataFrame:
    text = F.lower(text_or_empty())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, words, two hashes of the word sequence, bucket keys) of every row with a doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = word_hashes(b.column("text"))
            spans = list(zip(at.tolist(), at[1:].tolist()))
            fps = [_sequence(words[x:y]) for x, y in spans]
            keys = [sketch_pair(elements(words[x:y])) for x, y in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(np.diff(at), pa.int64()), *(pa.array([f[k] for f in fps], pa.int64()) for k in (0, 1)),
                                              *(pa.array([p[k].view(np.int64) for p in keys], pa.list_(pa.int64())) for k in (0, 1))],
                                             names=["doc_id", "h", "n", "fp1", "fp2", "few", "many"])
    return _norm(docs).where("doc_id is not null").mapInArrow(run, SKETCHED)


def _sequence(words: np.ndarray) -> tuple[int, int]:
    """128 bits of a word sequence."""
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    return tuple(int(mix(words * (2 * c) + place * c2).sum(dtype=np.uint64).view(np.int64)) for c, c2 in
                 ((words.dtype.type(0x9E3779B97F4A7C15 >> 1), words.dtype.type(0xC2B2AE3D27D4EB4F)), (words.dtype.type(0x165667B19E3779F9 >> 1), words.dtype.type(0x27D4EB2F165667C5))))


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar) of the pairs that reach ``similarity``."""
    named = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (wa, xa), (wb, xb) = (word_hashes(b.column(c)) for c in ("text_a", "text_b"))
            found = [aligned(elements(wa[xa[k]:xa[k + 1]]), elements(wb[xb[k]:xb[k + 1]]), similarity) for k in range(b.num_rows)]
            keep = pa.array([f >= similarity - 1e-9 for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similar"]).filter(keep)

    both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, LINKED)


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, doc, w) of the buckets with at least two representatives; w: how much a document shares with others."""
    rows = reps.select("doc", F.explode(F.concat("few", "many")).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, "key"), "buckets")
    return materialise(shared.join(shared.groupBy("doc").agg(F.sum("n").alias("w")), "doc").select("key", "doc", "w"), "weighted-buckets")


def _hub(rows: DataFrame, name: str) -> DataFrame:
    """The member of each bucket that shares most, by partial maxima."""
    return rows.groupBy("key").agg(F.max(F.struct("w", (-F.col("doc")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias(name))


def _classed(buckets: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, doc, class, n): the buckets' members with the classes known so far and their numbers of elements."""
    of = found.select(F.col("node").alias("doc"), F.col("component").alias("class"))
    rows = buckets.select("key", "doc").join(of, "doc", "left").join(reps.select("doc", "n"), "doc")
    return materialise(rows.select("key", "doc", F.coalesce("class", "doc").alias("class"), "n"), "classed-buckets")


def _narrowed(rows: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """``rows`` with every bucket that has more than a block outside its largest class replaced by buckets of rare elements.

    Two texts that reach the similarity share an element among the rarest n - ceil(similarity * n) + 1 of each
    (n: its elements), whatever order of rarity holds for both. So the members of such buckets meet under their
    rarest elements instead, and what they all have in common (a footer, a frame) brings nobody together.
    """
    words = rows.groupBy("key", "class").agg(F.sum("n").alias("words")).groupBy("key").agg((F.sum("words") - F.max("words")).alias("outside"))
    wide = materialise(words.where(F.col("outside") > block).select("key"), "wide-buckets")
    if wide.isEmpty():
        return rows
    docs = materialise(rows.join(wide, "key", "left_semi").select("doc", "class", "n").distinct(), "wide-members")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, at = word_hashes(b.column("text"))
            for doc, x, y in zip(b.column("doc").to_pylist(), at.tolist(), at[1:].tolist()):
                found = elements(w[x:y])
                first = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), doc), pa.int64()), pa.array(found.view(np.int64)), pa.array(np.full(len(found), first), pa.int64())],
                                                 names=["doc", "element", "first"])

    held = texts.select(F.col("doc_id").alias("doc"), "text").join(docs.select("doc"), "doc", "left_semi")
    held = materialise(held.select("doc", "text").mapInArrow(explode, "doc long, element long, first long"), "wide-elements")
    often = held.groupBy("element").agg(F.count("*").alias("often"))
    rarest = F.row_number().over(Window.partitionBy("doc").orderBy("often", "element"))  # the elements of one text
    rare = held.join(often, "element").withColumn("rank", rarest).where("rank <= first and often > 1").select("doc", F.col("element").alias("key"))
    narrow = rare.join(docs, "doc").select("key", "doc", "class", "n")
    return materialise(rows.join(wide, "key", "left_anti").select("key", "doc", "class", "n").unionByName(narrow), "narrow-buckets")


def _mixed(rows: DataFrame, block: int) -> DataFrame:
    """(key, lo, hi, place, doc, class): members of the buckets that span several classes, by pair of blocks to compare.

    Blocks of members outside the bucket's largest class come first (0 to ``few`` - 1), then those of the largest
    class; a pair has at least one of the former. Buckets with the same members are compared once.
    """
    same = [F.bit_xor(F.xxhash64("doc", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    sets = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("low"), F.max("class").alias("high"), *same).where("low <> high")
    kept = rows.join(sets.groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    shares = materialise(kept.groupBy("key", "class").agg(F.count("*").alias("m"), F.sum("n").alias("words")), "bucket-classes")
    blocks = lambda words: F.ceil(words / F.lit(block)).cast("int")
    plan = (shares.groupBy("key").agg(F.max(F.struct("m", "class", "words")).alias("top"), F.sum("words").alias("words"))
            .select("key", F.col("top.class").alias("top"), (F.col("words") <= block).alias("whole"), F.col("words") - F.col("top.words"), F.col("top.words"))
            .toDF("key", "top", "whole", "words_few", "words_top")
            .select("key", "top", F.when(F.col("whole"), 1).otherwise(blocks(F.col("words_few"))).alias("few"), F.when(F.col("whole"), 0).otherwise(blocks(F.col("words_top"))).alias("many")))
    salted = lambda n: F.pmod(F.xxhash64("doc", F.lit(7)), F.col(n)).cast("int")
    member = (kept.join(plan, "key").withColumn("in_top", (F.col("class") == F.col("top")) & (F.col("many") > 0))
              .withColumn("place", F.when(F.col("in_top"), F.col("few") + F.when(F.col("many") > 0, salted("many"))).otherwise(salted("few"))))
    partner = F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(F.col("in_top"), 0).otherwise(F.col("many"))))
    return (member.select("key", "doc", "class", "place", partner.alias("other"))
            .select("key", F.least("place", "other").alias("lo"), F.greatest("place", "other").alias("hi"), "place", "doc", "class"))


def links_across(doc: list[int], classes: list[int], place: list[int], texts: list[np.ndarray], similarity: float) -> list[tuple[int, int, float]]:
    """Links that join the classes of one pair of blocks (or of one block with itself) as far as any of its pairs do."""
    size = np.array([len(t) for t in texts])
    value, code = np.unique(np.concatenate(texts), return_inverse=True)
    holder = np.repeat(np.arange(len(texts)), size)[np.argsort(code, kind="stable")]
    at = np.searchsorted(np.sort(code), np.arange(len(value) + 1))
    ends = np.append(0, np.cumsum(size))
    parent = {c: c for c in classes}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    cls, where = np.array(classes), np.array(place)
    across = where.min() != where.max()
    kinds, counts = np.unique(cls, return_counts=True)
    out = []
    for i in np.flatnonzero(cls != kinds[np.argmax(counts)]).tolist():
        common = np.zeros(len(texts), np.int64)
        for c in code[ends[i]:ends[i + 1]].tolist():
            common[holder[at[c]:at[c + 1]]] += 1  # a text holds an element once
        near = (common > 0) & (common >= similarity * (size[i] + size - common) - 1e-9) & (cls != cls[i])
        if across:
            near &= where != where[i]
        for j in np.flatnonzero(near).tolist():
            x, y = root(classes[i]), root(classes[j])
            if x != y:
                got = aligned(texts[i], texts[j], similarity)
                if got >= similarity - 1e-9:
                    parent[x] = y
                    out.append((min(doc[i], doc[j]), max(doc[i], doc[j]), got))
    return out


def _links_in_mixed(mixed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar) of links between classes that share a bucket."""
    def run(group: pa.Table) -> pa.Table:
        col = group.column("text").combine_chunks()
        words, at = word_hashes(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)
        doc, classes, place = (group.column(c).to_pylist() for c in ("doc", "class", "place"))
        found = links_across(doc, classes, place, [elements(words[x:y]) for x, y in zip(at.tolist(), at[1:].tolist())], similarity) if len(set(classes)) > 1 else []
        return pa.table([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similar"])

    both = mixed.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return both.groupBy("key", "lo", "hi").applyInArrow(run, LINKED)


def row_classes(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, class_id, class_h) of every row with a doc_id: its text hash, and doc_id and text hash of the class's first row."""
    small_batches(docs.sparkSession)
    all_rows = materialise(sketched(docs), "sketches")
    copies = all_rows.where("n > 0").groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "h", "n", "few", "many")).alias("r")).select("fp1", "fp2", "r.*")
    # from here on a text goes by a number of its own, as one doc_id may have several texts
    reps = materialise(copies.withColumn("doc", F.monotonically_increasing_id()), "representatives")
    buckets = _buckets(reps)
    involved = buckets.select("doc").distinct().join(reps.select("doc", "doc_id", "h"), "doc")
    own = _norm(docs).join(involved.hint("merge"), ["doc_id", "h"])
    texts = materialise(own.groupBy("doc_id", "h", "doc").agg(F.first("text").alias("text")).select(F.col("doc").alias("doc_id"), "text"), "bucket-texts")
    first = materialise(_pairs(buckets.join(_hub(buckets, "hub"), "key").where("doc <> hub"), "doc", "hub"), "hub-pairs")
    links = materialise(verify(first, texts, similarity), "links")
    found = components(links)
    rows = _narrowed(_classed(buckets, found, reps), texts, similarity, block)
    more = materialise(_links_in_mixed(_mixed(rows, block), texts, similarity), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    linked = found.select(F.col("node").alias("doc"), "component").join(reps.select("doc", "doc_id", "h"), "doc")
    least = linked.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("m"))
    of = linked.select("doc", "component").join(least, "component").select("doc", "m")
    classed = (reps.select("fp1", "fp2", "doc", F.struct("doc_id", "h").alias("self")).join(of, "doc", "left")
               .select("fp1", "fp2", F.coalesce("m", "self").alias("m")))
    rows = all_rows.where("n > 0").select("doc_id", "h", "fp1", "fp2").join(classed, ["fp1", "fp2"]).select("doc_id", "h", F.col("m.doc_id").alias("class_id"), F.col("m.h").alias("class_h"))
    return rows.unionByName(all_rows.where("n = 0").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.col("h").alias("class_h")))


def near_duplicate_classes(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id) of every row with a doc_id; class_id is the smallest doc_id of the class."""
    return row_classes(docs, similarity, block).select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that come first in their class, each text of a doc_id once; rows without doc_id stay."""
    gone = row_classes(docs, similarity).where("doc_id <> class_id or h <> class_h").select("doc_id", "h").distinct()
    own = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lower(text_or_empty())).alias("h")
    kept = docs.select(F.struct("*").alias("d"), *own).join(gone, ["doc_id", "h"], "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "h"]).select("d.*").unionByName(kept.where("doc_id is null").select("d.*"))
