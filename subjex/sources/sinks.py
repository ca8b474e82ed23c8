"""Sinks (S12-S16). Stage tables are Parquet partitioned by member so that
appends of new (model, prompt) runs and later reads both stay partition-local.

Runs are committed: a writer stages its files in a batch folder of its own and then adds one
manifest version that names the batch of every run. Readers follow the last version, so they
see all of a commit or nothing of it, a run that is written again replaces its earlier
rows, and files of a writer that failed are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RUN = ("model", "prompt")
#: Commits that lose the race for a version start again from the winner's, this many times.
TRIES = 20


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """One small named file, in any file system Spark writes to."""
    _, where, fs = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file to a name that must not exist yet; False if it does."""
    jvm, src, _ = _fs(spark, source)
    context = jvm.FileContext.getFileContext(src.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        context.rename(src, jvm.Path(target), none)
        return True
    except Exception as e:  # a Java exception, told apart by its class
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[tuple[str, ...], str]]:
    """(last version, batch by run); version 0 where nothing was committed."""
    jvm, where, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(where):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    versions = sorted(n for n in names if n.endswith(".json"))
    if not versions:
        return 0, {}
    # a row per run: names, not data
    lines = spark.read.text(f"{path}/manifest/{versions[-1]}").collect()
    entries = [json.loads(r["value"]) for r in lines if r["value"]]
    return int(versions[-1].split(".")[0]), {tuple(e["run"]): e["batch"] for e in entries}


def commit_runs(df: DataFrame, path: str, key: Sequence[str] = RUN, drop: Sequence[tuple[str, ...]] = ()) -> int:
    """S12 + S13: write the runs in ``df`` so that they replace earlier rows of the same runs; other runs
    stay, but for those to ``drop``. Returns the committed version."""
    spark, batch = df.sparkSession, uuid.uuid4().hex
    staged = f"{path}/data/batch={batch}"
    typed = df.select(*(F.col(k).cast("string").alias(k) for k in key), *(c for c in df.columns if c not in key))
    typed.write.partitionBy(*key).parquet(staged)
    runs = [tuple(r) for r in spark.read.schema(_schema(typed, key)).parquet(staged).select(*key).distinct().collect()]
    for _ in range(TRIES):
        version, entries = manifest(spark, path)
        entries = {r: b for r, b in entries.items() if r not in drop} | {r: batch for r in runs}
        text = "\n".join(json.dumps({"run": list(r), "batch": b}) for r, b in sorted(entries.items()))
        draft = f"{path}/manifest/draft-{uuid.uuid4().hex}"
        write_text_file(spark, draft, text)
        if _move_new(spark, draft, f"{path}/manifest/{version + 1:012d}.json"):
            return version + 1
    raise RuntimeError(f"no commit to {path}: other writers came first {TRIES} times")


def _schema(df: DataFrame, key: Sequence[str]) -> StructType:
    """Partition names are text: a guessed type would turn a prompt "01" into 1."""
    return StructType([f for f in df.schema.fields if f.name not in key] + [StructField(k, StringType()) for k in key])


def read_runs(spark: SparkSession, path: str, key: Sequence[str] = RUN, runs: Sequence[tuple[str, ...]] | None = None) -> DataFrame:
    """The rows of the last committed version, of all runs or of the named ones; only their folders are read."""
    _, entries = manifest(spark, path)
    if not entries:
        raise ValueError(f"nothing was committed to {path}")
    live = [(b, *r) for r, b in entries.items() if runs is None or r in set(runs)]
    found = spark.read.option("mergeSchema", False).parquet(f"{path}/data/batch={next(iter(entries.values()))}")
    columns = _schema(found, ("batch", *key))
    rows = spark.read.schema(columns).option("basePath", f"{path}/data").parquet(f"{path}/data")
    # on partition columns only, so other folders are pruned
    name = F.concat_ws("\x00", "batch", *key)
    return rows.where(name.isin(["\x00".join(x) for x in live])).drop("batch")


def append_runs(df: DataFrame, path: str, partition_cols: Sequence[str] = RUN) -> None:
    """Append new runs; a run that is there already is replaced, so a replayed append leaves one copy."""
    commit_runs(df, path, partition_cols)


def overwrite_runs(df: DataFrame, path: str, partition_cols=("model", "prompt")) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite) of a plain Parquet table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*partition_cols).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A whole stage table (CSV with header for chains and curves)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def metrics_wide(metrics: DataFrame, suffix: str = "_value") -> DataFrame:
    """The overall metric rows as one wide row ``{metric}_value``."""
    overall = metrics.where((F.col("language") == "all") & (F.col("text_type") == "all"))
    names = ["prec", "rec", "f1", "rprec"]
    return overall.groupBy().pivot("metric", names).agg(F.first("value")) \
        .select(*[F.col(n).alias(f"{n}{suffix}") for n in names])


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON (one small file)."""
    metrics_wide(metrics).coalesce(1).write.mode("overwrite").json(path)


def write_metric_files(metrics: DataFrame, folder: str, set_only: bool = False) -> list[str]:
    """One file per overall metric, ``<metric>_opt.json`` (``<metric>.json`` for set scores without a cut), each
    holding ``{"<metric>_value": x}``. Returns the file names."""
    spark, names = metrics.sparkSession, []
    row = metrics_wide(metrics).first()  # one row
    for column, value in row.asDict().items():
        name = column.removesuffix("_value") + (".json" if set_only else "_opt.json")
        write_text_file(spark, f"{folder}/{name}", json.dumps({column: value}))
        names.append(name)
    return names
