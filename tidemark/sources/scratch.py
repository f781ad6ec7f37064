"""Intermediate tables in the shared folder that the session names; they cut lineage, outlive lost executors, and are deleted
when nothing reads them any more, at the latest when the driver ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []

#: Folders that were made and not dropped yet, in order.
_live: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path; write it or below it."""
    path = f"{root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The table, written once and read back, and its path."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    return write(df, label)[0]


def mark() -> frozenset[str]:
    """The folders that there are now."""
    return frozenset(_live)


def written_last(df: DataFrame, label: str, since: frozenset[str]) -> DataFrame:
    """``df`` written, and all folders dropped that were made after mark() gave ``since``: nothing else may read them."""
    late = [path for path in _live if path not in since]
    found = written(df, label)
    for path in late:
        drop(df.sparkSession, path)
    return found


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _live.pop(path, None)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a written table, which the file system knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


@atexit.register
def drop_all() -> None:
    """Delete what is left when the driver ends; results read their tables until then."""
    for path, spark in list(_live.items()):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone before the driver's Python
            return
