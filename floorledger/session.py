"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

#: Deletes a statement's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a task, where ``spread`` deals them.
TASK_ROWS = 250_000


def build_session(app: str = "floorledger", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FLOORLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``; a temporary one only where the cluster names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise one round of an iterative job on reliable storage, so a lost executor re-reads it.

    Written once as Parquet to the checkpoint folder and read back. A checkpoint of rows runs its last stage twice, stores rows whole and
    leaves the shuffle files of every round on disk; here those of the statement go when it ends. The folder goes with the application.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    _made().append(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS = threading.local()
T = TypeVar("T", DataFrame, tuple, dict)


def _made() -> list[str]:
    """Paths of the cuts that this thread has made and that are still there."""
    if not hasattr(_CUTS, "paths"):
        _CUTS.paths = []
    return _CUTS.paths


def lean(make: Callable[[], T]) -> T:
    """What ``make`` gives (a table, or a tuple or dict of some); of the cuts made on the way only those go on that the result still reads.

    Whatever else is to be read later has to be cut before, or be in the result. Shuffle files of the counts on the way go with them too.
    """
    begin = len(_made())
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        out = make()
    finally:
        spark.conf.set(CLEAN, before)
    frames = [d for d in (out.values() if isinstance(out, dict) else out if isinstance(out, tuple) else (out,)) if isinstance(d, DataFrame)]
    read = {f.rsplit("/", 2)[-2] for d in frames for f in d.inputFiles()}
    for path in _made()[begin:]:
        if path.rsplit("/", 1)[1] not in read:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _made().remove(path)
    return out


def dealt(df: DataFrame) -> DataFrame:
    """One side of a join between rows of entities: both sides are dealt by key.

    The planner takes a side for small by the size of its files, before it is exploded into cells, or by its compressed shuffle
    files, and then sends all of it through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key in parts of about TASK_ROWS, so that a task's memory stays as it is when the table grows.

    The planner makes a task of so many compressed bytes, which narrow rows of a few numbers fill by the million. One count of the rows.
    """
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)
