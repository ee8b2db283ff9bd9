"""Shared pieces: written intermediate tables, word splitting, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_local_roots: list[str] = []
_written: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_roots:
        _local_roots.append(tempfile.mkdtemp(prefix="sparkseek-"))
        atexit.register(shutil.rmtree, _local_roots[0], ignore_errors=True)
    return "file://" + _local_roots[0]


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts the lineage.

    The files outlive lost executors. They carry real sizes and no partitioning, so that later
    joins can be broadcast by size or have their skewed partitions split.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files that :func:`saved` wrote for these tables, once nothing reads them any more."""
    for df in tables:
        _deleted(df.sparkSession, df.written_at)


def swept(spark: SparkSession) -> int:
    """Delete all that :func:`saved` has written and nothing has dropped; how many tables. For when the results that read them are written."""
    paths = list(_written)
    for path in paths:
        _deleted(spark, path)
    return len(paths)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chunks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists from about ``size`` bytes each."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size and (cut := _SPACE.search(data, at + size)):
            end = cut.start()
        yield data[at:end].split()
        at = end


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)`` for every node of an edge.

    Each round lets every node follow its neighbour of least random priority, then renames the
    edges and drops those within a contracted node. Priorities change by round, so the edges shrink
    by a constant factor whatever the shape; hubs only meet map-side minima and skew-split joins.
    ``root`` is one node of the component, the same for all of its nodes.
    """
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(steps))
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("p"), F.col(c).alias("v"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        steps.append(saved(best.select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("root"))))
        to = steps[-1]
        half = left.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        half = saved(half.select("ra", "b"))
        full = half.join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        after = saved(full.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        dropped(left, half)
        left = after
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for to in steps[1:]:
        nxt = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
        longer = saved(found.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        dropped(found, to)
        found = longer
    return found
