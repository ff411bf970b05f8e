"""Written hand-over tables: computed once per session, read back by every later job.

They go to the shared folder named by spark.checkpoint.dir or, where that is not set, into the session's warehouse
folder (spark.sql.warehouse.dir), which driver and executors share as well. A machine-local folder is never used.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError("hand-over tables need a folder that driver and executors share: set spark.checkpoint.dir")
    return root.rstrip("/")


def version(spark: SparkSession, source: str) -> str:
    """A digest of the names, sizes and times of a folder's files, so that a changed source is built anew."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(source)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return ""
    seen, files = [], fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:12]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/winback/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged_path(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> str:
    """Where the named table of one source folder is; written on first use and again once the source has changed."""
    slot = (spark.sparkContext.applicationId, f"{source} {version(spark, source)}", name)
    if slot not in _WRITTEN:
        path = new_path(spark, f"{name}-{hashlib.sha1(source.encode()).hexdigest()[:8]}")
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[slot] = path
    return _WRITTEN[slot]


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The named table for one source folder, as written."""
    return spark.read.parquet(staged_path(spark, source, name, build))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame and read it back, to end a growing plan inside an iterative job."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
