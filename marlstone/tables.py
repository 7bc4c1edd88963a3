"""Tables and small files below the folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def files_of(spark: SparkSession, path: str):
    """The store of a path, and the path. On a local disk without checksum files: people edit what is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (files.getRawFileSystem() if files.getUri().getScheme() == "file" else files), at


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below spark.checkpoint.dir and read back: nothing above is computed again.

    Only where that is unset and the master is local, a temporary folder takes its place.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    try:
        files, at = files_of(spark, path)
        return files.delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        return False


def exists(spark: SparkSession, path: str) -> bool:
    files, at = files_of(spark, path)
    return files.exists(at)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern names, sorted."""
    files, at = files_of(spark, pattern)
    return sorted(x.getPath().toString() for x in files.globStatus(at) or [])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written aside and renamed."""
    files, at = files_of(spark, path)
    _, aside = files_of(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(aside, True)
    stream.write(text.encode())
    stream.close()
    files.delete(at, False)
    files.rename(aside, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    files, at = files_of(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()
