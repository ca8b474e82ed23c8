"""The streaming map job equals the batch map stage on the same answers."""

import os
import tempfile

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    from subjex.operators.infer import HashedNgramEncoder, completions, embed
    from subjex.plans import fixtures as X
    from subjex.plans.pipelines import map_stage
    from subjex.session import cut_lineage
    from subjex.sources.vocab import vocab_labels
    from subjex.streaming import mapping_stream as S

    ENCODER = HashedNgramEncoder()
    root = tempfile.mkdtemp(prefix="subjex-stream-")
    src = os.path.join(root, "responses")
    resp = X.responses(spark, SF).withColumn("doc_id", F.col("doc_id").cast("string"))
    # two arrivals: first turns, then the rest
    resp.where("prompt = '1'").write.parquet(os.path.join(src, "a"))
    resp.where("prompt <> '1'").write.parquet(os.path.join(src, "b"))
    vocab = cut_lineage(embed(vocab_labels(X.triples(spark, SF)), "label_text", encode=ENCODER))

    stream = spark.readStream.schema(S.RESPONSE_SCHEMA).option("recursiveFileLookup", True) \
        .option("maxFilesPerTrigger", 1).parquet(src)
    q = S.start(stream, vocab, os.path.join(root, "matches"), os.path.join(root, "pred"),
                os.path.join(root, "ckpt"), min_cosine=0.3, encode=ENCODER)
    q.awaitTermination(300)
    got = {tuple(r) for r in S.finalise(spark, os.path.join(root, "pred"))
           .select("model", "prompt", "doc_id", "label_id").collect()}

    best, _, _ = map_stage(completions(resp), vocab, min_cosine=0.3, score_param="cosine_similarity", encode=ENCODER)
    want = {tuple(r) for r in best.select("model", "prompt", "doc_id", "label_id").collect()}
    assert got == want and len(got) > 0
