"""Folders of the shared file system, through the file system Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, pattern: str) -> list[str]:
    """Full paths matching a glob pattern, sorted."""
    fs, p = _open(spark, pattern)
    found = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found is not None else []


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file unless it exists; tells whether this call created it.

    The file system decides between two callers, so exactly one of them gets True.
    """
    fs, p = _open(spark, path)
    try:
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
    except Exception:
        if fs.exists(p):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row is not None else ""


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)
