"""Session defaults and small helpers that every subpackage shares."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(master: str = "local[8]", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(master)
        .appName("plinth")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them.

    On a cluster the package is installed or shipped with ``--py-files``; this
    covers local runs that are started from another directory.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share, removed when the session ends.

    That is ``spark.checkpoint.dir``. Where the session names none, one is made and set if
    driver and executors are one process (tests); on a cluster that is an error.
    """
    import posixpath
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plinth-")
        spark.sparkContext.setCheckpointDir(base)
    path = posixpath.join(base if "://" in base or base.startswith("file:") else "file://" + base, f"{name}-{uuid.uuid4().hex}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back, so that what is made of it doesn't work it out again; cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core of the session, at least, that rows with much work each are dealt over.
_TASKS = 4


def tasks(spark: SparkSession) -> int:
    """Tasks that much work is dealt over: as many as the session can use, and more if it has more shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by the hash of columns ``by`` over as many tasks as the session can use.

    For rows that take long each: a small file of them is one partition, whatever the
    work, and tasks merged by their sizes are no better. The number is given, so adaptive
    execution leaves it; a table of more work has as many more tasks if the session has
    more shuffle partitions.
    """
    return df.repartition(tasks(df.sparkSession), *by)


#: Bytes of an Arrow batch to or from a Python worker, at most: a batch of long rows is held several times over.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
