"""Small files and folders through Hadoop's file systems, so that a data folder may lie anywhere Spark can read."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str, folders: bool | None = None) -> list[str]:
    """The sorted names in a folder, of folders or files alone if asked; none where there is no folder."""
    fs, p = _at(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if folders is None or s.isDirectory() == folders)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or a whole folder; says whether there was one."""
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, there with all its text or not at all."""
    fs, p = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(part, p):
        fs.delete(part, False)
        raise OSError(f"{path} is there already")
