"""Incremental map stage on Structured Streaming.

The reference runs every stage over whole files; nothing in it is streaming
(SURVEY 2.11). The stateless part of the pipeline - parse answers (F1),
look keywords up (J3), threshold (P3), prefix ids (P4) - runs unchanged on a
stream. This module wires it as a ``foreachBatch`` job, one folder per epoch:

* model answers arrive as files (``readStream``),
* each micro-batch parses them, searches only keywords never seen before
  (anti-join against the matches of earlier epochs, then the blocked kNN of
  M1) and writes those matches,
* the batch's predictions are written, partitioned by run, and so are the
  rows below the threshold where a folder for them is given.

A batch that is run again after a failure replaces its own epoch folders and
does not look at its own earlier matches, so every answer counts exactly once.

The best match per (doc, label) (A4) needs the whole run; it is computed in
batch over the appended table (``finalise``), which keeps the stream free of
unbounded state. Checkpoints go where the caller says (a shared folder on a
cluster). New keywords are embedded once per batch: ids and vectors are cut
from their lineage into the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from subjex.operators import mapping as M
from subjex.operators.infer import completions, embed
from subjex.operators.knn import nearest
from subjex.session import cut_lineage

RESPONSE_SCHEMA = "model string, prompt string, doc_id string, answer string"
MATCH_SCHEMA = "candidate string, label_id string, term string, cosine_similarity double, hybrid_score double"


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Model answers (model, prompt, doc_id, answer) as a stream."""
    r = spark.readStream.schema(RESPONSE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _matches(spark: SparkSession, matches_path: str, last: int) -> DataFrame:
    """Matches of the epochs up to ``last``; an empty first epoch makes the folder exist."""
    spark.createDataFrame([], MATCH_SCHEMA).write.mode("ignore").parquet(f"{matches_path}/epoch=-1")
    found = spark.read.schema(f"{MATCH_SCHEMA}, epoch long").parquet(matches_path)
    return found.where(F.col("epoch") <= last).drop("epoch")


def map_batch(batch: DataFrame, vocab: DataFrame, matches_path: str, out_path: str,
              min_cosine: float = 0.7, encode=None, epoch: int = 0, removed_path: str | None = None) -> None:
    """One micro-batch: parse, search new keywords, write the epoch's matches and predictions."""
    spark = batch.sparkSession
    comp = completions(batch)
    rows = M.count_rows(comp)
    cands = M.distinct_candidates(comp)
    known = _matches(spark, matches_path, epoch - 1)
    new = cands.join(known.select("candidate"), "candidate", "left_anti")
    q = cut_lineage(embed(new, "candidate", encode=encode).select(
        F.monotonically_increasing_id().alias("query_id"), "candidate", "embedding"))
    found = nearest(q.select("query_id", "embedding"), vocab, k=1).select(
        "query_id", "label_id", F.col("label_text").alias("term"),
        F.col("cosine").alias("cosine_similarity"), F.lit(None).cast("double").alias("hybrid_score"))
    fresh = q.select("query_id", "candidate").join(found, "query_id").drop("query_id")
    fresh.write.mode("overwrite").parquet(f"{matches_path}/epoch={epoch}")
    matches = _matches(spark, matches_path, epoch)
    kept, removed = M.split_threshold(M.attach_matches(rows, matches), min_cosine)
    M.prefix_ids(kept).write.mode("overwrite").partitionBy("model", "prompt").parquet(f"{out_path}/epoch={epoch}")
    if removed_path:
        removed.write.mode("overwrite").partitionBy("model", "prompt").parquet(f"{removed_path}/epoch={epoch}")


def start(responses: DataFrame, vocab: DataFrame, matches_path: str, out_path: str,
          checkpoint: str, min_cosine: float = 0.7, encode=None, available_now: bool = True,
          removed_path: str | None = None):
    """Start the streaming map job; returns the StreamingQuery."""
    w = responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, epoch: map_batch(df, vocab, matches_path, out_path, min_cosine, encode, epoch, removed_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def finalise(spark: SparkSession, out_path: str, score_param: str = "cosine_similarity") -> DataFrame:
    """A4 + P5 over everything written so far (batch)."""
    # runs are names: a guessed type would turn a prompt "01" into 1
    runs = ("model", "prompt")
    fields = [StructField(f.name, StringType()) if f.name in runs else f for f in spark.read.parquet(out_path).schema]
    rows = spark.read.schema(StructType(fields)).parquet(out_path).drop("epoch")
    return M.select_score(M.best_match(rows, by=["model", "prompt"]), score_param)
