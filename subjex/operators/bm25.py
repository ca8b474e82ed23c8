"""Keyword search (M3) and hybrid search (M2) as Spark jobs.

BM25 statistics (tf, document length, df, idf) are plain aggregates. The index
deals the label rows into ranges of about ``WIDTH``; the postings of a token within a range
are one block, and a small table holds each block's largest weight. A query first meets
that table only: the largest weights of its tokens add up to a bound on any score
in a range. Its most promising ranges are read, which gives a score to beat, and after them
only those ranges whose bound reaches it; all others are skipped unread. A posting
goes to the task of its range, whatever the number of queries; a task scores
its ranges with numpy and only the best rows of a query leave it.

Hybrid search fuses both scores over the whole vocabulary: blocks of queries meet batches of
label rows once, and only the rows on the hull of a query's scores leave a task.

A vocabulary holds one row per (label_id, label_text): a preferred label and
each of its alternatives are scored as texts of their own, never merged. The
row travels as ``row``, the md5 of its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subjex.operators.knn import CELLS, DIGITS, _matrix, block_count, spread, top_k

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
#: Label rows in a range; ranges that each query reads before it has a score to beat.
WIDTH, FIRST = 64, 2
#: Postings that a task scores at a time.
STEP = 4_000_000
FOUND = "query_id long, range int, no long, score double"


def tokens(c):
    """Lower-cased word tokens (letters and digits), empty pieces removed."""
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT, -1), "")


def round9(x: np.ndarray) -> np.ndarray:
    """The same 1e-9 rounding as ``stable_round``'s first step, in numpy."""
    return np.floor(x * 1e9 + 0.5) / 1e9


@dataclass
class KeywordIndex:
    """``postings`` (range, tok, no, weight), ``blocks`` (range, tok, n, most) and ``labels`` (range, no, label_id, row), all
    written once; ``no`` is a hash of the label row, ``tok`` of the token."""
    postings: DataFrame
    blocks: DataFrame
    labels: DataFrame
    ranges: int


def _place(ranges: int) -> list[Column]:
    """Range and number of a label row: two hashes of their own."""
    return [F.pmod(F.xxhash64(F.lit(1), "label_id", "row"), F.lit(ranges)).cast("int").alias("range"), F.xxhash64(F.lit(2), "label_id", "row").alias("no")]


def bm25_index(corpus: DataFrame, text_col: str = "label_text", k1: float = 1.2, b: float = 0.75,
               wanted: DataFrame | None = None, width: int = WIDTH) -> KeywordIndex:
    """The keyword index of a vocabulary, written once; reuse it for every query batch.
    With ``wanted`` (tok) only the postings of those tokens are counted and kept.

    weight = idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
    N = label rows, avgdl = tokens / N. Label rows and tokens travel as hashes. Rows of ``corpus`` are
    distinct; those without an id are no labels."""
    from subjex.session import cut_lineage
    docs = spread(corpus.select("label_id", text_col)).where("label_id is not null") \
        .select("label_id", F.md5(text_col).alias("row"), F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t)).alias("toks"))
    rows = cut_lineage(docs.select("label_id", "row", F.size("toks").alias("dl"), "toks"))  # each text is split once
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens")).first()
    n, avgdl = int(totals["n"]), float(totals["tokens"] or 0) / max(int(totals["n"]), 1)
    ranges = max(1, math.ceil(n / width))
    # a range stays in one task from here on: its tokens are counted there, and its blocks come from few files
    held = rows.select(*_place(ranges), "dl", "toks").repartition("range").select("range", "no", "dl", F.explode("toks").alias("tok"))
    if wanted is not None:
        held = held.join(wanted, "tok", "left_semi")
    tf = cut_lineage(held.groupBy("range", "no", "tok").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))
    df = cut_lineage(tf.groupBy("tok").agg(F.count(F.lit(1)).alias("df")))
    copies = cut_lineage(rows.groupBy(*_place(ranges)).agg(F.count(F.lit(1)).cast("int").alias("copies")).where("copies > 1"))
    if not copies.isEmpty():  # a row given more than once has its postings as often
        tf = tf.join(copies, ["range", "no"], "left") \
            .select("range", "no", "tok", "tf", "dl", F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1)))))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl if avgdl > 0 else 1.0))
    postings = cut_lineage(tf.join(df, "tok").select("range", "tok", "no", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight")))
    blocks = cut_lineage(postings.groupBy("range", "tok").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("most")))
    return KeywordIndex(postings, blocks, rows.select(*_place(ranges), "label_id", "row"), ranges)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Concatenation of arange(lo[i], hi[i]) without a Python loop."""
    n = hi - lo
    keep = n > 0
    lo, n = lo[keep], n[keep]
    if not len(n):
        return np.zeros(0, dtype=np.int64)
    starts = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return starts + np.arange(n.sum())


def query_tokens(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(query_id, tok): the distinct tokens of each query."""
    split = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(query_col)))).alias("token"))
    return split.select("query_id", F.xxhash64("token").alias("tok")).distinct()


def _best_of_ranges(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows, with all that tie with the last, of every query over the ranges of one task: ``left`` (query_id,
    range, tok) and ``right`` (range, tok, no, weight)."""
    empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "range": pd.Series([], dtype="int32"),
                          "no": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
    if left.empty or right.empty:
        return empty
    right = right.sort_values(["range", "tok"], kind="stable").reset_index(drop=True)
    spans = right.groupby(["range", "tok"], sort=True).size().rename("n").reset_index()
    spans["hi"] = spans["n"].cumsum()
    hits = left.merge(spans, on=["range", "tok"]).sort_values("query_id", kind="stable")
    if hits.empty:
        return empty
    rng, no, weight = (right[c].to_numpy() for c in ("range", "no", "weight"))
    code = right.groupby(["range", "no"], sort=True).ngroup().to_numpy()
    _, at_label = np.unique(code, return_index=True)
    qid, hi, n = hits["query_id"].to_numpy(), hits["hi"].to_numpy(), hits["n"].to_numpy()
    qcode = np.cumsum(np.append(0, (qid[1:] != qid[:-1]).astype(np.int64)))
    ends = np.flatnonzero(np.append(qcode[1:] != qcode[:-1], True)) + 1  # queries stay whole within a step
    upto, out, at = np.cumsum(n), [], 0
    while at < len(qid):
        before = upto[at - 1] if at else 0
        stop = int(ends[max(np.searchsorted(upto[ends - 1], before + STEP, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        idx = _ranges(hi[at:stop] - n[at:stop], hi[at:stop])
        pair, back = np.unique(np.repeat(qcode[at:stop], n[at:stop]) * len(at_label) + code[idx], return_inverse=True)
        score = np.bincount(back.reshape(-1), weights=weight[idx])
        q, l, s9 = pair // len(at_label), pair % len(at_label), round9(score)
        order = np.lexsort((-s9, q))
        q, l, s9, score = q[order], l[order], s9[order], score[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        size = np.diff(np.append(begin, len(q)))
        last = s9[begin + np.minimum(size, k) - 1]  # the k-th score of each query
        keep = s9 >= np.repeat(last, size)
        out.append(pd.DataFrame({"query_id": qid[at:stop][np.searchsorted(qcode[at:stop], q[keep])], "range": rng[at_label[l[keep]]],
                                 "no": no[at_label[l[keep]]], "score": score[keep]}))
        at = stop
    return pd.concat(out)


def _score_ranges(index: KeywordIndex, pairs: DataFrame, qtok: DataFrame, k: int, query_blocks: int, buckets: int) -> DataFrame:
    """Best rows of each (query_id, range) in ``pairs``: only the blocks that some pair needs are read and move."""
    from subjex.session import cut_lineage
    bucket = F.pmod("range", F.lit(buckets)).alias("bucket")
    qb = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb")
    qx = pairs.join(qtok, "query_id").select("query_id", "range", "tok", bucket, qb)
    need = cut_lineage(qx.select("range", "tok", "qb").distinct())  # where it is small, the postings are read in place
    dx = index.postings.join(need, ["range", "tok"]).select(F.col("range").alias("range"), F.col("tok").alias("tok"), "no", "weight", bucket, "qb")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best_of_ranges(left[["query_id", "range", "tok"]], right[["range", "tok", "no", "weight"]], k)
    keys = ["bucket", "qb"]
    return qx.groupBy(*keys).cogroup(dx.groupBy(*keys)).applyInPandas(score, FOUND)


def range_bounds(index: KeywordIndex, qtok: DataFrame) -> DataFrame:
    """(query_id, range, bound): no row of the range scores more for the query."""
    return qtok.join(index.blocks.select("range", "tok", "most"), "tok").groupBy("query_id", "range").agg(F.sum("most").alias("bound"))


def postings_of(index: KeywordIndex, pairs: DataFrame, qtok: DataFrame) -> int:
    """Postings in the blocks that the (query_id, range) ``pairs`` need, each counted once."""
    need = pairs.join(qtok, "query_id").select("range", "tok").distinct()
    return int(index.blocks.join(need, ["range", "tok"], "left_semi").agg(F.sum("n")).first()[0] or 0)


def _search(index: KeywordIndex, qtok: DataFrame, k: int, query_block_bytes: int, label_block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found rows, ranges read first, ranges read after them)."""
    from subjex.functions.scores import stable_round
    from subjex.session import cut_lineage
    query_blocks = block_count(qtok.count(), 24, query_block_bytes)
    total = int(index.blocks.agg(F.sum("n")).first()[0] or 0)
    cores = qtok.sparkSession.sparkContext.defaultParallelism
    buckets = min(index.ranges, max(block_count(total, 64, label_block_bytes), cores))
    bounds = cut_lineage(range_bounds(index, qtok))
    first = top_k(bounds.withColumn("row", F.col("range")), FIRST, "query_id", "bound").select("query_id", "range")
    found = cut_lineage(_score_ranges(index, first, qtok, k, query_blocks, buckets))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "no")
    beat = found.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == k).select("query_id", stable_round(F.col("score"), 9).alias("beat"))
    # a row that only equals the score to beat may still win by its id; the margin covers sums in another order
    rest = bounds.join(first, ["query_id", "range"], "left_anti").join(beat, "query_id", "left") \
        .where(F.col("beat").isNull() | (F.col("bound") >= F.col("beat") - 1e-8)).select("query_id", "range")
    rest = cut_lineage(rest)
    return found.unionByName(_score_ranges(index, rest, qtok, k, query_blocks, buckets)), first, rest


def bm25(queries: DataFrame, corpus: DataFrame | None = None, k: int = 1, query_col: str = "query",
         text_col: str = "label_text", k1: float = 1.2, b: float = 0.75,
         query_block_bytes: int = 64 << 20, label_block_bytes: int = 256 << 20,
         index: KeywordIndex | None = None) -> DataFrame:
    """M3: the k label rows of greatest BM25 score per query (distinct query
    tokens; rows sharing no token with a query are not returned; ties by
    label_id, then row, after rounding scores to 1e-9): (query_id, label_id, row, score).

    Without an ``index`` one is built that holds the queries' tokens only. Ranges whose bound
    stays below a query's k-th best score so far are never read for it."""
    from subjex.functions.scores import stable_round
    from subjex.session import cut_lineage
    qtok = cut_lineage(query_tokens(queries, query_col))
    if index is None:
        index = bm25_index(corpus, text_col, k1, b, qtok.select("tok").distinct())
    found, _, _ = _search(index, qtok, k, query_block_bytes, label_block_bytes)
    # a task returns ties of its last place, so what comes here is k rows and ties per query and task
    named = found.join(index.labels, ["range", "no"]).select("query_id", "label_id", "row", "score", stable_round(F.col("score"), 9).alias("_s9"))
    return top_k(named, k, "query_id", "_s9").drop("_s9")


def bm25_pairs(pairs: DataFrame, qtok: DataFrame, index: KeywordIndex) -> DataFrame:
    """``pairs`` (query_id, label_id, row) with their ``score``; 0 where no token is shared."""
    at = pairs.select("query_id", "label_id", "row", *_place(index.ranges))
    hit = at.join(qtok, "query_id").join(index.postings, ["range", "no", "tok"]).groupBy("query_id", "label_id", "row").agg(F.sum("weight").alias("score"))
    return pairs.select("query_id", "label_id", "row").join(hit, ["query_id", "label_id", "row"], "left").fillna(0.0, ["score"])


def _batch_scores(queries: pa.Table, labels: pa.RecordBatch, idf: np.ndarray, avgdl: float, k1: float, b: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, cosines, keyword scores) of each query of a block, with the ``idf`` of its tokens, against all label rows of a batch."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    q, v, n = unit(_matrix(queries.column("embedding"))), unit(_matrix(pa.chunked_array([labels.column("embedding")]))), labels.num_rows
    lists = queries.column("toks").combine_chunks()
    ends, asked = np.cumsum(lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    wanted, first, own = np.unique(asked, return_index=True, return_inverse=True)
    idf = idf[first]
    held = labels.column("toks")
    tok, row = held.flatten().to_numpy(), np.repeat(np.arange(n), held.value_lengths().to_numpy())
    at = np.searchsorted(wanted, tok)
    known = at < len(wanted)
    known[known] = wanted[at[known]] == tok[known]
    posting, tf = np.unique(at[known] * n + row[known], return_counts=True)  # by token, then by row
    at, row = posting // n, posting % n
    copies, dl = (labels.column(c).to_numpy(zero_copy_only=False)[row] for c in ("copies", "dl"))
    tf = tf * copies  # a row given more than once has its tokens and its postings as often
    weight = copies * idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl if avgdl > 0 else 1.0)))
    lo, hi = (np.searchsorted(at, np.arange(len(wanted)), side=side) for side in ("left", "right"))
    chunk = max(1, CELLS // max(n, 1))
    for begin in range(0, len(q), chunk):
        cosines = np.round(q[begin:begin + chunk] @ v.T, DIGITS)
        for i in range(begin, begin + len(cosines)):
            mine = own[ends[i - 1] if i else 0:ends[i]]
            idx = _ranges(lo[mine], hi[mine])
            yield i, cosines[i - begin], np.bincount(row[idx], weights=weight[idx], minlength=n)


def _may_win(c: np.ndarray, s: np.ndarray, place: np.ndarray, c_tol: float, s_tol: float) -> np.ndarray:
    """Points (c, s) of which one has the greatest a c + b s, whatever the factors a, b >= 0 (not both 0) are, ties by ``place``.

    Such a point lies on the upper right of the convex hull, or so close below it (the tolerances) that rounding may let it tie.
    A point that is nowhere greater than one of smaller place never wins."""
    right, top = np.argmax(c), np.argmax(s)
    a, b = s[top] - s[right], c[right] - c[top]
    some = (c + c_tol >= c[right]) | (s + s_tol >= s[top])
    if a > 0 or b > 0:  # the hull runs above the line between its ends
        some |= a * (c + c_tol) + b * (s + s_tol) >= a * c[right] + b * s[right]
    some = np.flatnonzero(some)
    c, s, place = c[some], s[some], place[some]
    order = np.lexsort((-c, -s))
    c_run = np.maximum.accumulate(c[order])
    steps = order[np.append(True, c[order][1:] > c_run[:-1])]  # s falls, c grows
    hull: list[int] = []
    for i in steps:
        while len(hull) > 1 and (c[hull[-1]] - c[hull[-2]]) * (s[i] - s[hull[-2]]) >= (s[hull[-1]] - s[hull[-2]]) * (c[i] - c[hull[-2]]):
            hull.pop()
        hull.append(int(i))
    near = np.flatnonzero((c + c_tol >= c[hull[-1]]) | (s + s_tol >= np.interp(c + c_tol, c[hull], s[hull])))
    near, won = near[np.argsort(place[near], kind="stable")], []
    while len(near):
        won.append(near[0])
        near = near[(c[near] > c[near[0]]) | (s[near] > s[near[0]])]
    return some[won]


#: What a pair of blocks finds: rows that may win a query, with the query's extremes over the batch that they come from.
CANDIDATES = "query_id long, label_id string, row string, c double, s double, v_min double, v_max double, k_max double"


def _candidates(queries: pa.Table, labels: pa.RecordBatch, alpha: float, n: int, avgdl: float, k1: float, b: float) -> pa.RecordBatch:
    named = np.flatnonzero(labels.column("row").is_valid().to_numpy(zero_copy_only=False))  # a label without a text has a cosine only
    order = pc.sort_indices(pa.table([labels.column(c) for c in ("label_id", "row")], ["label_id", "row"]), sort_keys=[("label_id", "ascending"), ("row", "ascending")])
    place = np.empty(labels.num_rows, np.int64)
    place[order.to_numpy()] = np.arange(labels.num_rows)
    lists, most = queries.column("df").combine_chunks(), (k1 + 1) * float(np.square(labels.column("copies").to_numpy(zero_copy_only=False).max()))
    df = lists.flatten().to_numpy()
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    total = np.add.reduceat(np.append(idf, 0.0), np.append(0, np.cumsum(lists.value_lengths().to_numpy())[:-1]))
    qi, li, cs, ss, ends = [], [], [], [], []
    for i, c, s in _batch_scores(queries, labels, idf, avgdl, k1, b):
        # rounding the fused score may tie what differs by 1e-9 there: by that much of the widest range in each score
        tol = (4e-9 / alpha if alpha > 0 else 0.0, 4e-9 * most * max(float(total[i]), 1.0) / (1 - alpha) if alpha < 1 else 0.0)
        x, y = (c[named] if alpha > 0 else np.zeros(len(named))), (s[named] if alpha < 1 else np.zeros(len(named)))
        best = named[_may_win(x, y, place[named], *tol)] if len(named) else np.array([-1])
        qi.append(np.full(len(best), i))
        li.append(best)
        cs.append(c[best])
        ss.append(s[best])
        ends.append(np.tile([[c.min(), c.max(), s.max()]], (len(best), 1)))
    qi, li, cs, ss, ends = (np.concatenate(x) for x in (qi, li, cs, ss, ends))
    taken = pa.array(li, mask=li < 0)
    return pa.RecordBatch.from_arrays([queries.column("query_id").combine_chunks().take(pa.array(qi)), labels.column("label_id").take(taken), labels.column("row").take(taken),
                                       *(pa.array(x) for x in (cs, ss, *ends.T))], names=[x.split()[0] for x in CANDIDATES.split(", ")])


def hybrid(queries: DataFrame, vocab: DataFrame, alpha: float = 0.7, depth: int | None = None,
           query_col: str = "query", text_col: str = "label_text", block_bytes: int = 64 << 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """M2: the label row of greatest fused score per query, over the whole vocabulary.

    fused = alpha * vector + (1 - alpha) * keyword; vector is the cosine scaled by the query's least and greatest cosine over all
    label rows (1 where they are equal), keyword the BM25 score over the query's greatest one (0 without a
    shared token). Ties by label_id, then row. An alternative label competes by its own vector and its own text.
    Also returns the true cosine of the winner, on which the mapping threshold works.

    A block of queries meets each group of label rows once: the queries, with the document frequencies of their tokens, are held, the label rows, with
    their vector and tokens, pass in batches. The extremes that scale the scores are known at the end only, but whatever they are, the
    winner lies on the hull of a batch's scores, so a few rows per query and batch leave a task (:func:`_may_win`). Label rows are
    written once, counted where they stand, and move once per block of queries; queries move once per group of label rows.
    Both lists are read to their ends; ``depth``, how far to read them first, has no effect.
    """
    from subjex.functions.scores import stable_round
    from subjex.functions.vectors import cosine as cos_expr
    from subjex.session import cut_lineage
    q = cut_lineage(queries.where("query_id is not null").select("query_id", F.col(query_col).alias("query"), "embedding"))
    v = cut_lineage(vocab.where("label_id is not null").select(
        "label_id", F.md5(text_col).alias("row"), F.col(text_col).alias("term"), "embedding",
        F.sort_array(F.transform(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")), lambda t: F.xxhash64(t))).alias("toks"))
        .withColumn("dl", F.size("toks")))
    width = lambda df: int(df.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0])
    n, held, avgdl = v.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0)), F.coalesce(F.sum("dl") / F.count_if(F.lit(True)), F.lit(0.0))).first()
    copies = cut_lineage(v.groupBy("label_id", "row").agg(F.count(F.lit(1)).cast("int").alias("copies")).where("copies > 1 and row is not null"))
    once, right = v, v.drop("term").withColumn("copies", F.lit(1))
    if not copies.isEmpty():
        once = v.dropDuplicates(["label_id", "row"])
        right = v.drop("term").join(copies, ["label_id", "row"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    df = once.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).cast("int").alias("df"))
    asked = query_tokens(q).join(df, "tok").select("query_id", F.struct("tok", "df").alias("_t"))
    none = lambda c, of: F.coalesce(c, F.array().cast(f"array<{of}>"))
    left = cut_lineage(q.drop("query").join(asked.groupBy("query_id").agg(F.sort_array(F.collect_list("_t")).alias("_t")), "query_id", "left")
                       .select("query_id", "embedding", none(F.col("_t.tok"), "bigint").alias("toks"), none(F.col("_t.df"), "int").alias("df")))
    n_left, asks = left.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("toks")), F.lit(0.0))).first()
    cores = q.sparkSession.sparkContext.defaultParallelism
    bq = block_count(n_left, 8 * width(left) + int(12 * asks) + 64, block_bytes)
    bv = block_count(n, 8 * width(v) + int(8 * held) + 64, 4 * block_bytes, -(-2 * cores // bq), min_rows=500)
    tasks = 1 if bq * bv == 1 else min(8 * bq * bv, max(16 * cores, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = left.select("*", F.pmod(F.xxhash64("query_id"), F.lit(bq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(bv - 1))).alias("vb"), F.lit(0).alias("side"))
    y = right.select("*", F.pmod(F.xxhash64("label_id", "row"), F.lit(bv)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"), F.lit(1).alias("side"))
    keys, avgdl = ["qb", "vb"], float(avgdl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of the block come first, then its label rows."""
        parts, held = [], None
        for rows in batches:
            labels = int(np.searchsorted(rows.column("side").to_numpy(zero_copy_only=False), 1))
            if labels:
                parts.append(rows.slice(0, labels).select(["query_id", "embedding", "toks", "df"]))
            if labels < rows.num_rows and parts:
                held = held or pa.Table.from_batches(parts)
                yield _candidates(held, rows.slice(labels), alpha, n, avgdl, k1, b)
    met = x.unionByName(y, allowMissingColumns=True).repartition(tasks, *keys).sortWithinPartitions(*keys, "side").groupBy(*keys).applyInArrow(meet, CANDIDATES)
    every = Window.partitionBy("query_id")
    lo, hi, most = F.min("v_min").over(every), F.max("v_max").over(every), F.max("k_max").over(every)
    found = met.select("query_id", "label_id", "row", "c", "s", lo.alias("lo"), hi.alias("hi"), most.alias("most")).where("row is not null")
    fused = F.lit(alpha) * F.when(F.col("hi") > F.col("lo"), (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0)) \
        + F.lit(1 - alpha) * F.when(F.col("most") > 0, F.col("s") / F.col("most")).otherwise(F.lit(0.0))
    found = found.select("query_id", "label_id", "row", fused.alias("hybrid_score"))
    winners = top_k(found.withColumn("_s9", stable_round(F.col("hybrid_score"), 9)), 1, "query_id", "_s9").drop("_s9")
    return winners.join(q.select("query_id", F.col("embedding").alias("_q")), "query_id") \
        .join(v.select("label_id", "row", "term", F.col("embedding").alias("_v")), ["label_id", "row"]) \
        .select("query_id", "label_id", "term", "hybrid_score", cos_expr(F.col("_q"), F.col("_v")).alias("cosine"))
