"""The best match per (doc, label) kept on a stream (A4, SURVEY 2.11).

State is one row per (model, prompt, doc, label): the match of greatest cosine, ties to the
greatest candidate, and the greatest hybrid score. A row that changes nothing emits
nothing; a change emits the whole new state, so the sink can replace by key. The rule is a
maximum, so the order of arrival, the cut into batches and rows seen twice do not
matter. State leaves after ``ttl_ms`` of processing time without a change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["model", "prompt", "doc_id", "label_id"]
MATCH = "candidate string, term string, cosine_similarity double, hybrid_score double"
CHANGES = f"model string, prompt string, doc_id string, label_id string, {MATCH}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestMatch(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", MATCH, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.best.get() if self.best.exists() else None
        best = None if held is None else tuple(held)
        for pdf in rows:
            for candidate, term, cosine, hybrid in pdf[["candidate", "term", "cosine_similarity", "hybrid_score"]].itertuples(index=False, name=None):
                best = _greater(best, (_none(candidate), _none(term), _none(cosine), _none(hybrid)))
        if best != (None if held is None else tuple(held)):
            self.best.update(best)
            yield pd.DataFrame([[*key, *best]], columns=[*KEY, "candidate", "term", "cosine_similarity", "hybrid_score"])

    def close(self) -> None:
        pass


def _none(x):
    return None if x is None or x != x else x


def _greater(held: tuple | None, new: tuple) -> tuple:
    """The match of the greater (cosine, candidate), with the greater hybrid score of both; nulls are least."""
    if held is None:
        return new
    rank = lambda m: (m[2] is not None, m[2] or 0.0, m[0] is not None, m[0] or "")
    best = new if rank(new) > rank(held) else held
    hybrid = max((m[3] for m in (held, new) if m[3] is not None), default=None)
    return (*best[:3], hybrid)


def best_match_changes(matches: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes of the best match from a stream of kept matches (model, prompt, doc_id, label_id, candidate, term,
    cosine_similarity, hybrid_score); needs the RocksDB state store (:func:`use_state_store`)."""
    rows = matches.select(*(F.col(k).cast("string").alias(k) for k in KEY), "candidate", "term", "cosine_similarity", "hybrid_score")
    return rows.groupBy(*KEY).transformWithStateInPandas(BestMatch(ttl_ms), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def write_changes(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write every batch's changes to a folder of its own, so that a repeated batch replaces them; returns the query."""
    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    w = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def current(spark, path: str) -> DataFrame:
    """The best match per key as of the last change."""
    rows = spark.read.schema(f"{CHANGES}, epoch long").parquet(path)
    last = F.max_by(F.struct("candidate", "term", "cosine_similarity", "hybrid_score"), "epoch")
    return rows.groupBy(*KEY).agg(last.alias("m")).select(*KEY, "m.*")
