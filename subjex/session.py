"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "subjex") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster call this without ``master``; the launcher decides. Shuffle
    partitions default to AQE-coalesced 2x cores when not given.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # a hot document may be split even where the split costs one more
         # shuffle (the evaluation joins keep their document partitioning)
         .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that one task of a shuffle sorts or aggregates.
ROWS_PER_TASK = 500_000


def size_shuffles(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> None:
    """Raise the session's number of shuffle partitions so that ``rows`` make tasks of bounded size; it is never
    lowered, and AQE merges what turns out small. A fixed number would let a task's memory grow with the input."""
    wanted = -(-rows // per_task)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is set.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session. Only a local-mode session (tests, bench) without the
    setting gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
    path = tempfile.mkdtemp(prefix="subjex-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """``df`` written once below the shared checkpoint folder and read back: survives executor loss, and unlike an
    eager checkpoint it computes its input once."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
