"""Resampling by target features, clusters over approximations, certified packing: against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import functions as F

from subjex.llm import bin_packing, queries, target_resampling, va_clusters
from tests.llm.conftest import SMOKE

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def _buckets(words):
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def _resampled_by_hand(docs, target):
    """One tuple (doc_id, n_features, weight, score, rank) per row."""
    of = [(i, _words(t)) for i, t in docs]
    counted = [_buckets(w) for _, w in of]
    s, t = Counter(), Counter()
    for c in counted:
        s.update(c)
    for text in target:
        t.update(_buckets(_words(text)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000.0) / ((s[b] + 1.0) * (t_all + 10000.0))))
    out = []
    for (i, w), c in zip(of, counted):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * n for b, n in c.items())
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crc_of_runs_and_shifts():
    rng = random.Random(5)
    texts = ["", "x" * 5000 + " y", "A\nb\n\nc  d", "é ü\nß", "a" * 64 + "b " + "c" * 63 + "\nd", "one"]
    texts += ["".join(rng.choice("aB9é \n.x") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for crossing in (False, True):
        n, col = target_resampling.features(pa.array(texts), crossing)
        for text, k, got in zip(texts, n.tolist(), col.to_pylist()):
            want = _buckets(_words(text))
            if crossing:
                for line in text.split("\n"):
                    want.subtract(_buckets(_words(line)))
            assert k == len(_words(text)) and Counter(np.frombuffer(got, "<u2").tolist()) == +want, text


def test_features_in_steps(monkeypatch):
    texts = pa.array(["a b c d e f g h\ni j k", "l m", "n", "", "o p q r s"])
    whole = [target_resampling.features(texts, c)[1].to_pylist() for c in (False, True)]
    monkeypatch.setattr(target_resampling, "STEP", 3)
    stepped = [target_resampling.features(texts, c)[1].to_pylist() for c in (False, True)]
    assert [[sorted(x[i:i + 2] for i in range(0, len(x), 2)) for x in part] for part in whole] == [[sorted(x[i:i + 2] for i in range(0, len(x), 2)) for x in part] for part in stepped]


def test_resampling_equals_brute_force(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables(spark, "documents").collect()]
    target = [r.text for r in tables(spark, "benchmark").collect()]
    got = sorted((tuple(r) for r in queries.op11_target_resampling(spark, SMOKE).collect()), key=str)
    assert got == _resampled_by_hand(docs, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(len(_words(t)) >= 20 for _, t in docs) // 100 > 0


def test_resampling_of_odd_rows_and_hot_lines(spark, odd, empty, monkeypatch):
    target = spark.createDataFrame([("own words of the fourth text",), (None,), ("a line of some length",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = _resampled_by_hand(rows, [r.text for r in target.collect()])
    named = ["doc_id", "n_features", "weight", "score", "rank"]
    take = lambda df: sorted((tuple(r) for r in df.select(named).collect()), key=str)
    assert take(target_resampling.draw(target_resampling.weigh(odd, target))) == want
    monkeypatch.setattr(target_resampling, "HOT", 3)  # the shared line is more than a third of all
    assert take(target_resampling.draw(target_resampling.weigh(odd, target))) == want
    assert take(target_resampling.draw(target_resampling.weigh(empty, target))) == []
    none = target.where("false")
    assert take(target_resampling.draw(target_resampling.weigh(odd, none))) == _resampled_by_hand(rows, [])
    drawn = target_resampling.resample(odd, target, percent=100, min_words=1)
    assert drawn.columns == odd.columns and drawn.count() == sum(bool(_words(t)) for _, t in rows)


def _clustered_by_hand(vectors, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    x = np.array([v for _, v in kept], np.int64).reshape(len(kept), 64)
    near = lambda: np.array([((x - np.array(c)) ** 2).sum(1) for c in centroids]).T
    for _ in range(rounds if kept else 0):
        own = near().argmin(1)
        centroids = [[int(s) // int((own == c).sum()) for s in x[own == c].sum(0)] if (own == c).any() else old for c, old in enumerate(centroids)]
    if not kept:
        return []
    d = near()
    own = d.argmin(1)
    best = d[np.arange(len(x)), own]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(c), int(b), int(best[own == c].sum()), int(best.sum()), sha[c]) for (i, _), c, b in zip(kept, own, best)), key=str)


def test_clusters_equal_brute_force(spark, tables):
    vectors = [(r.vec_id, r.embedding) for r in tables(spark, "embeddings").collect()]
    got = sorted((tuple(r) for r in queries.op12_va_clusters(spark, SMOKE).collect()), key=str)
    assert got == _clustered_by_hand(vectors)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(8)
    v = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    one = v()
    rows = [(k, v()) for k in range(60)] + [(100, None), (101, []), (102, one[:63]), (103, [None] + one[1:]), (104, [float("nan")] + one[1:]), (105, [float("inf")] + one[1:])]
    rows += [(7, one), (7, one), (None, one), (None, v()), (200, [0.0] * 64), (201, [-0.0] * 64), (202, [900.0] + [0.0] * 63)] + [(300 + k, one) for k in range(40)]
    frame = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, row int")
    out = lambda f: sorted((tuple(r) for r in va_clusters.with_inertia(*va_clusters.cluster(f)).collect()), key=str)
    assert out(frame.repartition(5)) == _clustered_by_hand(rows)
    assert out(frame.where("vec_id < 3")) == _clustered_by_hand(rows[:3])
    assert out(frame.where("vec_id = 101")) == []


def test_intervals_hold_and_spare_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 400, (5, 64))
    v = (centre[rng.integers(0, 5, 3000)] + rng.normal(0, 60, (3000, 64))).astype(np.int64)
    for bits in (2, 4, 6, 8):
        grid = va_clusters.Grid(v.min(0), v.max(0), bits)
        cells = grid.cells(v)
        assert np.array_equal(va_clusters.unpack_cells(va_clusters.pack_cells(cells, bits), 64, bits), cells)
        centroids = v[:8]
        sure = va_clusters.Tables(grid, centroids).sure(cells)
        exact, _ = va_clusters.nearest(v, centroids)
        assert np.array_equal(sure[sure >= 0], exact[sure >= 0])
    assert (sure >= 0).mean() > 0.8
    frame = spark.createDataFrame([(i, (x / 1024).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = va_clusters.materialise(va_clusters.scaled(frame).withColumn("row", F.monotonically_increasing_id()), "w")
    _, fetched = va_clusters.fit(whole, 8, 10, 3)
    assert len(fetched) == 9 and sum(fetched) < 0.5 * 9 * len(v)


def _check_packing(rows, docs, size=4096):
    """Every id of every document is in place once; sequences are whole and gapless. Returns their number."""
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), size)):
            want[(i, k, a, min(size, len(ids) - a), zlib.crc32(ids[a:a + size].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r[5]].append((r[6], r[3]))
    for parts in held.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= size
    return len(held)


def test_packing_of_documents(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables(spark, "documents").collect()]
    rows = queries.op13_bin_packing(spark, SMOKE).collect()
    used = _check_packing(rows, docs)
    lengths = np.array([r.length for r in rows if r.length < 4096])
    assert used == sum(r.length == 4096 for r in rows) + bin_packing.lower_bound(lengths, 4096)


def test_packing_of_odd_rows(spark, odd, empty):
    texts = odd.unionByName(spark.createDataFrame([(50, "a <|endoftext|> b<|startoftext|>", *[None] * 10)], odd.schema))
    packed = bin_packing.pack(texts, WORD_BPE, 1)
    rows = packed.select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset").collect()
    _check_packing(rows, [(r.doc_id, r.text) for r in texts.collect()])
    for r in bin_packing.sequences(packed).collect():
        own = sorted((x for x in packed.where(F.col("sequence_id") == r.sequence_id).collect()), key=lambda x: x.offset)
        assert bytes(r.ids) == b"".join(bytes(x.ids) for x in own) and r.doc_ids == [x.doc_id for x in own]
    assert bin_packing.pack(empty, WORD_BPE, 1).count() == 0


def _fewest(lengths, size):
    """Fewest sequences, by search over all packings."""
    lengths = sorted(lengths, reverse=True)
    for k in range(1, len(lengths) + 1):
        free = [size] * k

        def fill(i):
            if i == len(lengths):
                return True
            for b in {f: j for j, f in enumerate(free) if f >= lengths[i]}.values():
                free[b] -= lengths[i]
                if fill(i + 1):
                    return True
                free[b] += lengths[i]
            return False
        if fill(0):
            return k
    return 0


def test_bounds_never_pass_the_fewest():
    rng, tight = random.Random(4), 0
    for _ in range(150):
        size = rng.choice([10, 12, 30, 100])
        lengths = [rng.randint(1, size - 1) for _ in range(rng.randint(1, 9))]
        fewest, bound = _fewest(lengths, size), bin_packing.lower_bound(np.array(lengths), size)
        assert bound <= fewest <= bin_packing.best_fit(np.array(lengths), size)[0].max() + 1
        tight += bound == fewest
    assert tight > 130
    assert bin_packing.lower_bound(np.array([51] * 7), 100) == 7 and bin_packing.lower_bound(np.array([34] * 7), 100) == 4


def test_partitions_exchange_pieces(spark):
    rng = np.random.default_rng(6)
    lengths = np.concatenate([rng.integers(1, 400, 3000), rng.integers(300, 700, 3000)])
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, length int")
    alone, first = bin_packing.place(items, 1000, part=300, rounds=1)
    placed, report = bin_packing.place(items, 1000, part=300)
    count = lambda df: df.select("sequence").distinct().count()
    assert first[0]["partitions"] == 20 and count(placed) < count(alone) == first[0]["sequences"]
    assert placed.count() == len(lengths) == placed.select("id").distinct().count()
    assert count(placed) <= 1.003 * bin_packing.lower_bound(lengths, 1000) and len(report) > 1
    filled = placed.join(items, "id").groupBy("sequence").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n > 1000 or n <> end").isEmpty()
