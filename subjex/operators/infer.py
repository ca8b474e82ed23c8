"""Model calls as Arrow-batched ``mapInPandas`` stages (M5, M6, M7).

The caller supplies the model as a plain function over a list of strings
(an embedding encoder, a text generator); it is created once per task
(``factory``) and fed batches, the way the reference feeds its GPU engine.
Answers are joined back by key; nothing loops on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


def _batches(pdf: pd.DataFrame, size: int):
    for s in range(0, len(pdf), size):
        yield pdf.iloc[s:s + size]


#: Bytes of rows and vectors that ``embed`` returns at a time; a batch of a model may be much smaller.
OUT_BYTES = 1 << 20


def embed(df: DataFrame, text_col: str, encode: Callable[[list[str]], np.ndarray] | None = None,
          batch: int = 32, factory: Callable[[], Callable] | None = None) -> DataFrame:
    """M5: ``embedding`` (array<float>, unit L2 norm) for every row.

    ``encode(list[str]) -> (n, d) array`` or a ``factory`` returning one
    (built once per task); one of them is required."""
    if encode is None and factory is None:
        raise ValueError("embed needs an encoder: encode or factory")
    schema = StructType(df.schema.fields + [StructField("embedding", ArrayType(FloatType()), True)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = factory() if factory else encode
        for rows in it:  # some thousand rows; texts are decoded a model batch at a time and returned OUT_BYTES at a time
            begin, done, held = 0, [], 0
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                m = np.asarray(enc(["" if x is None else x for x in part.column(text_col).to_pylist()]), dtype=np.float64)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                done.append(m.astype(np.float32))
                held += part.nbytes + done[-1].nbytes
                if held >= OUT_BYTES or lo + batch >= rows.num_rows:
                    m, part = np.concatenate(done), rows.slice(begin, lo + part.num_rows - begin)
                    vectors = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, "embedding"])
                    begin, done, held = begin + part.num_rows, [], 0

    return df.mapInArrow(run, schema)


def generate(df: DataFrame, prompt_col: str, fn: Callable[[list[str]], list[str]] | None = None,
             batch: int = 20, factory: Callable[[], Callable] | None = None,
             out_col: str = "answer") -> DataFrame:
    """M6 / M7: one answer per prompt row; the model gets ``batch`` prompts
    at a time and must return as many answers (checked, as the rank stage
    checks it)."""
    schema = StructType(df.schema.fields + [StructField(out_col, StringType(), True)])

    def run(it):
        model = factory() if factory else fn
        for pdf in it:
            answers: list[str] = []
            for b in _batches(pdf, batch):
                got = list(model(b[prompt_col].tolist()))
                if len(got) != len(b):
                    raise ValueError("number of answers does not match number of prompts")
                answers.extend(got)
            yield pdf.assign(**{out_col: answers})

    return df.mapInPandas(run, schema)


STORED = "key string, answer string"


def answer_key(model: Column, prompt: Column) -> Column:
    """The identity of a question: what is asked of which model."""
    return F.sha2(F.concat_ws("\x00", model, prompt), 256)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of everything answered so far; an answer written twice counts once."""
    # an empty first part makes the folder exist
    spark.createDataFrame([], STORED).write.mode("ignore").parquet(f"{path}/part=-1")
    return spark.read.schema(STORED).parquet(path).groupBy("key").agg(F.min("answer").alias("answer"))


#: Characters of the questions that a task holds and sorts.
TASK_CHARS = 32 << 20


def ask(df: DataFrame, store: str, fn: Callable[[list[str]], list[str]] | None = None, factory: Callable[[], Callable] | None = None, prompt_col: str = "text",
        model_col: str = "model", batch: int = 20, parts: int = 8, out_col: str = "answer", expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """M6 / M7, resumable: ``df`` with an ``answer``, asking only what the answer ``store`` does not hold.

    Questions are distinct (model, prompt text) pairs. Those without an answer are asked in ``parts`` (by hash of the row that
    holds them), each written to the store when it is done: a restart repeats one part at most, and the same questions of another
    run or a later call are answered from the store. Within a task questions go in order of length, so the prompts of
    a batch are of like length.

    ``expand`` makes the questions of each row of ``df`` (all its other columns kept, with ``model_col``, ``prompt_col`` and ``_place``,
    a number of the question within its row); it must give the same questions each time. What is written and
    moved is then ``df`` once and a key per question, never the prompt texts, and the result has no ``prompt_col``.
    """
    from subjex.session import cut_lineage
    spark, key = df.sparkSession, answer_key(F.col(model_col), F.col(prompt_col))
    source = cut_lineage(df.withColumn("_source", F.monotonically_increasing_id()))  # each part reads it
    questions = expand or (lambda rows: rows.withColumn("_place", F.lit(0)))
    keyed = cut_lineage(questions(source).withColumn("_key", key).withColumn("_chars", F.length(prompt_col)).drop(prompt_col))
    # the one place where a question is taken from
    first = cut_lineage(keyed.where("_chars is not null").groupBy("_key").agg(F.min(F.struct("_source", "_place")).alias("_at"), F.max("_chars").alias("_chars"))
                        .select("_key", "_at._source", "_at._place", "_chars"))
    chars = first.agg(F.sum("_chars")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-chars // (parts * TASK_CHARS)))
    part = F.pmod(F.xxhash64("_source"), F.lit(parts))
    for k in range(parts):
        known = read_store(spark, store).select(F.col("key").alias("_key"))
        new = first.where(part == k).join(known, "_key", "left_anti").groupBy("_source").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_key"))).alias("_keys"))
        texts = questions(source.where(part == k).repartition(tasks, "_source").join(new, "_source")).where(F.map_contains_key("_keys", F.col("_place"))) \
            .select(F.col("_keys")[F.col("_place")].alias("key"), F.col(prompt_col).alias("prompt")).sortWithinPartitions(F.length("prompt"), "key")
        generate(texts, "prompt", fn, batch, factory).select("key", "answer").write.mode("append").parquet(f"{store}/part={k}")
    answers = read_store(spark, store).select(F.col("key").alias("_key"), F.col("answer").alias(out_col))
    asked = keyed if expand else source.withColumn("_key", key)
    return asked.join(answers, "_key", "left").drop("_key", "_source", "_place", "_chars")


class HashedNgramEncoder:
    """Character 3-gram feature hashing into ``dim`` signed buckets (CRC32).
    Similar strings get similar vectors; used in tests and examples."""

    def __init__(self, dim: int = 64, n: int = 3):
        self.dim, self.n = dim, n

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for r, t in enumerate(texts):
            s = f" {t.lower()} "
            for i in range(max(1, len(s) - self.n + 1)):
                h = zlib.crc32(s[i:i + self.n].encode("utf-8"))
                out[r, h % self.dim] += 1.0 if (h >> 16) & 1 else -1.0
        return out


def completions(responses: DataFrame) -> DataFrame:
    """F1 applied: (model, prompt, doc_id, answer) -> (model, prompt, doc_id, candidate)."""
    from subjex.functions.text import answer_keywords
    return responses.select("model", "prompt", "doc_id",
                            F.explode(answer_keywords(F.col("answer"))).alias("candidate"))
