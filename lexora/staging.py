"""Tables and files in the folder that driver and executors share.

Staged tables cut lineage and survive the loss of executors. The folder is
``spark.checkpoint.dir``, or the context's checkpoint folder; only a local
master may go without, and gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_ROOTS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context not in _ROOTS:
            path = f"file://{tempfile.mkdtemp(prefix='lexora-')}"
            context.setCheckpointDir(path)
            _ROOTS[context] = path
        root = _ROOTS[context]
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; removed when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_quiet_remove, spark, path)
    return path


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path  # type: ignore[attr-defined]
    return out


def unstage(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "_staged", None)
        if path:
            remove(df.sparkSession, path)
