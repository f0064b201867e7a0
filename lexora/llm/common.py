"""Shared helpers: input tables, staging in the shared folder, Arrow batches."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.staging import remove, shared_dir, shared_root, stage, unstage  # noqa: F401  used by the operators from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches of at most `rows` whole texts: a worker and the JVM each hold several batches at once."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (0, 10_000):  # the default; a chosen value stays
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def pinned(df: DataFrame, label: str = "input") -> DataFrame:
    """df where it only projects or filters scans of files, whose rows have the same places at every reading; anything else is staged first.

    Scans are cut by the number of cores that Spark has just then, unless a
    least number of partitions is set; it is set here, so that the cut stays
    when executors come or go.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", df.sparkSession.sparkContext.defaultParallelism)

    def still(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in ("Project", "Filter", "LogicalRelation") and all(still(children.apply(k)) for k in range(children.size()))

    return df if still(df._jdf.queryExecution().optimizedPlan()) else stage(df, label)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df over all shuffle partitions, for rows that stand for much work: evenly, or by a hash of columns.

    The hash is an expression that no plan is partitioned by yet, so that Spark
    can't leave the exchange out, and adaptive execution doesn't merge the
    partitions of an exchange with a given number.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*columns)) if columns else df.repartition(n)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case."""
    taken, k = {c.lower() for c in df.columns}, 0
    while f"__{name}_{k}" in taken:
        k += 1
    return f"__{name}_{k}"


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain path; works on executors."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, write) -> None:
    """write(stream) to a hidden name, then rename: a retried or speculative task never leaves half a file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(temporary, compression=None) as out:
        write(out)
    fs.move(temporary, path)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+length-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc32_mod4(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4
