"""The keyword index: one pass over the texts, rows given more than once."""

import os
import uuid

from pyspark.sql import functions as F


def test_the_keyword_index_reads_each_text_once(spark, tmp_path):
    from subjex.operators import bm25 as B
    log = str(tmp_path / "rows")
    os.makedirs(log)

    def seen(batches):
        for b in batches:
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(b)))
            yield b
    rows = [(f"l{i}", f"alpha{i % 7} beta{i % 5} word{i}") for i in range(300)]
    corpus = spark.createDataFrame(rows, "label_id string, label_text string").repartition(4)
    q = spark.createDataFrame([(1, "alpha3 beta2"), (2, "word17"), (3, "none")], "query_id long, query string")
    plain = sorted(tuple(r) for r in B.bm25(q, corpus, k=3).collect())
    for f in os.listdir(log):
        os.unlink(f"{log}/{f}")
    got = sorted(tuple(r) for r in B.bm25(q, corpus.mapInPandas(seen, corpus.schema), k=3).collect())
    assert got == plain and {r[1] for r in got if r[0] == 2} == {"l17"}
    assert sum(int(open(f"{log}/{f}").read()) for f in os.listdir(log)) == len(rows)


def test_rows_given_twice_count_twice_in_the_index(spark):
    from subjex.operators import bm25 as B
    rows = [("a", "one two two"), ("a", "one two two"), ("b", "two three"), ("c", None)]
    index = B.bm25_index(spark.createDataFrame(rows, "label_id string, label_text string"))
    assert index.labels.count() == 4 and index.blocks.agg(F.sum("n")).first()[0] == 6
    a = index.labels.join(index.postings, ["range", "no"]).where("label_id = 'a'").groupBy("tok").agg(F.min("weight").alias("w"), F.max("weight").alias("x")).collect()
    assert len(a) == 2 and all(r.w == r.x for r in a)
