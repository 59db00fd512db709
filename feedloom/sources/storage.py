"""Files and folders on the shared storage, through Spark's own file system layer."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Storage that doesn't promise that only one of two writers creates a file.
UNSAFE_SCHEMES = frozenset({"s3", "s3a", "s3n", "oss", "cosn", "obs", "swift"})


class UnsafeStorage(ValueError):
    """Claims and manifests need a file system on which creating a file is decided once."""


def folder(spark: SparkSession, path: str):
    """The path and its file system, as objects of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def require_safe(spark: SparkSession, path: str) -> None:
    _, fs = folder(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme in UNSAFE_SCHEMES:
        raise UnsafeStorage(f"{path}: two writers may both create a file on {scheme}; keep the table on a file system that decides")


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = folder(spark, path)
    return fs.exists(where)


def _listed(spark: SparkSession, path: str) -> list:
    where, fs = folder(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


def subfolders(spark: SparkSession, path: str) -> list[str]:
    return sorted(s.getPath().getName() for s in _listed(spark, path) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[str]:
    return sorted(s.getPath().getName() for s in _listed(spark, path) if s.isFile())


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    where, fs = folder(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of a finished run."""
    where, fs = folder(spark, path)
    fs.delete(where, True)


def create_file(spark: SparkSession, path: str, content: str, replace: bool = False) -> bool:
    """Write a small file; False if it is there already and isn't to be replaced."""
    where, fs = folder(spark, path)
    try:
        out = fs.create(where, replace)
    except Py4JJavaError:
        if not fs.exists(where):
            raise
        return False
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's content; None where there is none."""
    where, fs = folder(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds of the storage's clock; 0 where there is none."""
    where, fs = folder(spark, path)
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else 0


def clock(spark: SparkSession, near: str) -> int:
    """The storage's own time, so that the clocks of two drivers needn't agree."""
    probe = f"{near}/.clock-{uuid.uuid4().hex}"
    create_file(spark, probe, "")
    now = modified(spark, probe)
    discard(spark, probe)
    return now
