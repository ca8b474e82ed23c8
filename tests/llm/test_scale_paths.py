"""The paths that large inputs take, made to run on small ones."""

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

from subjex.llm import line_dedup, order_minhash, token_shards
from subjex.llm.common import materialise
from tests.llm.test_corpus_operators import _classes_by_hand
from tests.llm.test_text_operators import _lines_by_hand


def _footed(n, seed):
    """Unrelated short texts with one long footer, and a shortened copy of every tenth."""
    rng, footer = random.Random(seed), " ".join(f"footer{k}" for k in range(14))
    texts = {}
    for _ in range(n):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
        texts[len(texts)] = f"{own} {footer}"
        if rng.random() < 0.1:
            texts[len(texts)] = f"{own} {footer}".rsplit(" ", 1)[0]
    return texts


def test_texts_with_a_common_footer_meet_under_rare_elements(spark, monkeypatch):
    texts = _footed(300, 4)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    met, mixed = [], order_minhash._mixed

    def counted(rows, block):
        out = materialise(mixed(rows, block), "mixed")
        met.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "_mixed", counted)
    want = _classes_by_hand(texts)
    assert len(set(want.values())) < len(texts)
    for block in (order_minhash.BLOCK, 300):
        assert {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(frame, block=block).collect()} == want
    monkeypatch.setattr(order_minhash, "_narrowed", lambda rows, *_: rows)
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(frame, block=300).collect()} == want
    assert met[1] < len(texts) < 5 * len(texts) < met[2]  # rows sent to tasks: with rare elements, and by pairs of blocks


def test_rare_elements_lose_no_link(spark):
    """Texts of many similarities around 0.8, all in buckets beyond a block."""
    rng = random.Random(7)
    base = [[f"b{g}x{k}" for k in range(60)] for g in range(3)]
    texts = {}
    for i in range(150):
        t = list(base[i % 3])
        a, b = rng.randrange(0, 8), rng.randrange(0, 8)
        texts[i] = " ".join([*(f"p{rng.randrange(3)}q{k}" for k in range(a)), *t[a:60 - b], *(f"s{rng.randrange(3)}q{k}" for k in range(b))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(frame, block=100).collect()}
    assert got == _classes_by_hand(texts)


def test_hot_line_in_arrays_that_stay_in_their_files(spark, odd, monkeypatch):
    rng, hot = random.Random(5), "this line stands in a third of all documents"
    lines = [f"shared line number {k} of some length" for k in range(40)]
    rows = [(i, "\n".join([*rng.choices(lines, k=3), *([hot, f"  {hot.upper()}"] if i % 3 == 0 else []), f"own line {i}"])) for i in range(600)]
    rows += [(0, rows[0][1]), (None, hot), (601, None), (602, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(line_dedup, "PROBES", 50)
    for shard_keys in (1, 4, 1000):
        got = line_dedup.drop_repeated_lines(docs, shard_keys=shard_keys, slice_mb=0)
        assert Counter(map(tuple, got.collect())) == _lines_by_hand(rows)
    want = _lines_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert Counter(map(tuple, line_dedup.drop_repeated_lines(odd, shard_keys=1, slice_mb=0).collect())) == want


def test_token_shards_follow_the_measured_size(spark, tables, monkeypatch, tmp_path):
    docs = tables(spark, "documents")
    encoded = lambda path: sorted(map(tuple, token_shards.encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, path).collect()))
    want = encoded(str(tmp_path / "few"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(token_shards, "SHARD_BYTES", size // 20)
    assert encoded(str(tmp_path / "many")) == want
    shards = [spark.read.parquet(f"{tmp_path}/{x}/manifest").count() for x in ("few", "many")]
    assert shards[0] <= 8 < shards[1] <= 21
