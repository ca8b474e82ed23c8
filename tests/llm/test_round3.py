"""Findings of the second advice."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from subjex.llm import deobfuscate, order_minhash, spaced_seeds


def _template_texts(groups, members, seed):
    """Filled-in forms: groups of copies of one text whose fields take few values each, with similarities on both sides of 0.8."""
    rng, texts = random.Random(seed), {}
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(130)]
        fields = rng.sample(range(3, 127, 6), 11)
        for _ in range(members):
            t = list(base)
            for f in fields:
                if rng.random() < .45:
                    t[f] = f"v{rng.randint(0, 2)}"
            texts[len(texts)] = " ".join(t)
    return texts


def _bucket_classes(texts):
    """Components of all pairs that share a bucket and align, without hubs."""
    words, at = order_minhash.word_hashes(pa.array(list(texts.values()), pa.string()))
    e = [order_minhash.elements(words[x:y]) for x, y in zip(at, at[1:])]
    parent, buckets = list(range(len(e))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x
    for i, s in enumerate(e):
        for k in np.concatenate(order_minhash.sketch_pair(s)).tolist():
            buckets[k].append(i)
    done = set()
    for b in buckets.values():
        for i, j in itertools.combinations(b, 2):
            x, y = sorted((root(i), root(j)))
            if x != y and (i, j) not in done:
                done.add((i, j))
                if order_minhash.aligned(e[i], e[j], 0.8) >= 0.8 - 1e-9:
                    parent[y] = x
    return {i: root(i) for i in range(len(e))}


def test_near_duplicate_forms_equal_all_pairs_of_each_bucket(spark):
    for members, block in ((600, order_minhash.BLOCK), (200, 4000)):  # one block a bucket, and several
        texts = _template_texts(1, members, 1)
        frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(frame, block=block).collect()}
        assert got == _bucket_classes(texts)


def test_disguises_are_found_without_unrelated_words(monkeypatch):
    card = "two oh two five oh five oh one two three four five six seven eight"
    texts = ["john_at_example.com", "jane-at-example.org", "plus 49 3012345678", "(four one one one one one one one one one one one one one one one)",
             "+49 30 one 2345678", "a@fünf.com", "call/+one five five five one two three four five six seven/", card]
    found = [deobfuscate.added_spans(t, deobfuscate.base_spans(t)) for t in texts]
    assert all(found[:7])
    rng = random.Random(4)
    parts = ["john", "example", "com", " ", " ", " ", "at", "dot", "_", "-", "@", ".", "+", "plus", "one", "two", "oh", "fünf", "Zéro", "ONE", "4111", "1", "30", "(", ")", "[", "]", "/", ",", "\n",
             "&#64;", "%2e", "o", "l", "168", "192", "un", "más", "ät", "&period;", "|", "~", "{", "}", "\t", "K", "ı"]
    runs = ["one ", "two-", "oh ", "five. ", "1 ", "1111 ", "(", ")", "+", "plus ", "2", " dot ", "four,", "\n"]
    for k in range(30_000):
        texts.append("".join(rng.choice(runs if k % 2 else parts) for _ in range(rng.randint(1, 30))))
    gated = [deobfuscate.added_spans(t, deobfuscate.base_spans(t)) for t in texts]
    monkeypatch.setattr(deobfuscate, "_disguised", lambda text: True)
    for t, g in zip(texts, gated):
        assert g == deobfuscate.added_spans(t, deobfuscate.base_spans(t)), t
    assert sum(map(bool, gated)) > 100


def test_overlaps_by_row_over_several_slices(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(14))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, items[0][1]), (1, "nothing here"), (1, items[1][1] + " and " + items[2][1]), (None, items[3][1]), (None, None), (2, " ".join(t for _, t in items))], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = rows(spaced_seeds.find_overlaps(docs, bench))
    assert len(whole) == 6

    def several(benchmark, slice_mb):
        def each():
            for k in range(3):
                part = benchmark.where(F.col("item_id") % 3 == k).collect()
                yield spark.sparkContext.broadcast(([r.item_id for r in part], [r.text for r in part]))
        return 3, each()
    clean = rows(spaced_seeds.keep_clean(docs, bench))
    monkeypatch.setattr(spaced_seeds, "slices", several)
    assert rows(spaced_seeds.find_overlaps(docs, bench)) == whole
    assert rows(spaced_seeds.keep_clean(docs, bench)) == clean == sorted([(1, "nothing here"), (None, None)], key=str)


def test_short_items_and_other_scripts(spark):
    items = [(1, "how many legs does an adult spider have"), (2, "日本で一番高い山は富士山です"), (3, "one two three four five"), (4, "a b c"), (5, "le « chat » — noir dort ici ce soir encore")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([
        (10, "so: How many LEGS does an old spider have? eight"), (11, "how many arms does an old spider have"), (12, "前文。日本で一番高い山は富士山です。後文"), (13, "日本で一番高い丘は富士山です"),
        (14, "日本で二番低い丘は大雪山です"), (15, "x one two three four five y"), (16, "one two three four six"), (17, "a b c"), (18, "le chat noir dort ici ce soir encore"),
        (19, "le\u00a0chat\u2014noir, dort ici ce matin encore"), (20, None)], "doc_id long, text string")
    got = {r.doc_id: r.best_item for r in spaced_seeds.find_overlaps(docs, bench).collect()}
    assert got == {10: 1, 11: None, 12: 2, 13: 2, 14: None, 15: 3, 16: None, 17: None, 18: 5, 19: 5, 20: None}


def test_short_items_in_every_place(spark):
    words = [f"w{k}" for k in range(11)]
    for n in range(spaced_seeds.SHORTEST, spaced_seeds.WINDOW):
        index = spaced_seeds.Index([7], [" ".join(words[:n])])
        for wrong in itertools.combinations(range(n), n // spaced_seeds.SHORT_RATE):
            text = " ".join(["x", *("other" if k in wrong else w for k, w in enumerate(words[:n])), "y"])
            assert [x[1] for x in index.overlaps(pa.array([text]))] == [7]
        more = " ".join("other" if k in (0, n // 2, n - 1) else w for k, w in enumerate(words[:n]))
        assert index.overlaps(pa.array([more])) == []


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(80))
    a, b, c = text(), text(), text()
    edited = lambda t, k: " ".join(w if i != 40 else f"edit{k}" for i, w in enumerate(t.split()))
    rows = [(3, a), (5, a), (5, b), (2, edited(a, 1)), (8, edited(b, 2)), (9, c), (9, edited(c, 3)), (9, c), (9, ""), (9, None), (None, a), (10, "")]
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, h string, d int").repartition(3)
    got = sorted(map(tuple, order_minhash.near_duplicate_classes(frame).collect()))
    first = [(2, 2), (3, 2), (5, 2), (5, 5), (8, 5)]
    assert got == sorted(first + [(9, 9)] * 5 + [(10, 10)])
    for _ in range(2):
        kept = sorted(((r.doc_id, r.text or "") for r in order_minhash.keep_one(frame).collect()), key=str)
        assert [x for x in kept if x[0] != 9] == sorted([(2, edited(a, 1)), (5, b), (10, ""), (None, a)], key=str)
        nine = [t for i, t in kept if i == 9]
        assert len(nine) == 2 and "" in nine and set(nine) - {""} < {c, edited(c, 3)}


def test_recall_by_share_of_edited_words(spark):
    """Planted copies with a share of their words replaced: no link of 0.8 or more is lost; the shares that link are in the README."""
    rng, texts, planted = random.Random(12), {}, {}
    for base in range(250):
        words = [f"b{base}w{rng.randint(0, 5000)}" for _ in range(rng.choice([60, 150, 400, 1500]))]
        texts[len(texts)] = " ".join(words)
        origin = len(texts) - 1
        for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            t = list(words)
            for k in rng.sample(range(len(t)), max(1, round(share * len(t)))):
                t[k] = f"e{rng.randint(0, 10**9)}"
            planted[len(texts)] = (origin, share)
            texts[len(texts)] = " ".join(t)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(frame).collect()}
    words, at = order_minhash.word_hashes(pa.array(list(texts.values()), pa.string()))
    e = [order_minhash.elements(words[x:y]) for x, y in zip(at, at[1:])]
    linked, alike, together = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, (origin, share) in planted.items():
        near = order_minhash.aligned(e[origin], e[i], 0.8) >= 0.8 - 1e-9
        alike[share] += near
        linked[share] += near and got[i] == got[origin]
        together[share] += got[i] == got[origin]
    print({s: (alike[s], linked[s], together[s]) for s in sorted(alike)})
    assert sum(linked.values()) >= 0.99 * sum(alike.values())
    assert all(together[s] >= 0.9 * 250 for s in (0.005, 0.01))
