"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one of ``spark.checkpoint.dir``; in local mode, a temporary one that goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="sparkseek-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = "file://" + _local[0]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    where, files = _system(spark, path)
    return files.getFileStatus(where).isDirectory()


def stamp(spark: SparkSession, path: str) -> int:
    """Time of the last change of a file or folder."""
    where, files = _system(spark, path)
    return files.getFileStatus(where).getModificationTime()


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a saved table or index, if it is there."""
    where, files = _system(spark, path)
    return files.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    where, files = _system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    where, files = _system(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small text file whole, under another name first; false if the file is there already."""
    where, files = _system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(part, False)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.write(content, stream, "UTF-8")
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(part), files.makeQualified(where), kinds)  # never over another file
    except Exception:
        files.delete(part, False)
        if files.exists(where):
            return False
        raise
    return True
