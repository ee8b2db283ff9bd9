"""Versions of a saved index: immutable segments, bits of deleted records, and manifests that one rename commits.

Under the folder of an index, ``manifests`` holds a small JSON file for each version. It names the segments that make up the
version and the deltas that later deletions left; everything else lies in ``<table>/segment=<id>`` and never changes. A
reader keeps to the version that it opened. A writer first writes its files and then renames its manifest to the next
number: a failed one leaves files that no version names, and of two at a time the second one fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.sources import scratch

#: Columns of the tables by bucket, for versions that have no row of one.
SCHEMAS = {
    "terms": "term string, heading long, body long, label long, breadcrumb long, first struct<seq:long,pos:int>, dense boolean",
    "blocks": "term string, block long, heading int, body int, words boolean, whole boolean, hi_heading int, hi_body int, lo_heading int, lo_body int, "
    + ", ".join(f"least{i} double" for i in range(8)),
    "frequencies": "term string, field string, n long, of string",
    "grams": "term string, gram string",
    "neighbours": "variant string, key string, tier int, seq long, pos int",
    "completions": "prefix string, rank int, heading string, seq long",
    "postings": "term string, seq long, words int, label boolean, in_heading array<int>, in_body array<int>, in_label int, in_breadcrumb int, tf long, heading_length int, body_length int, label_length int, breadcrumb_length int, heading_words int",
}
TABLES = ("records", "postings", "blocks", "terms", "frequencies", "headings", "grams", "neighbours", "completions", "deletions")


@dataclass(frozen=True)
class Segment:
    """Records written together, or with ``delta`` the bits and negative frequencies of records deleted together."""

    id: str
    buckets: int
    records: int
    delta: bool = False
    empty: tuple[str, ...] = ()  # tables by bucket without a row


@dataclass(frozen=True)
class Manifest:
    """A version: what it is made of, and the sums that scores need, over its live records."""

    version: int
    built: int  # milliseconds
    segments: tuple[Segment, ...]
    next_seq: int
    records: int
    sized: int  # records whose heading and body are both known
    chars: int  # characters of those

    @property
    def mean(self) -> float | None:
        return self.chars / self.sized if self.sized else None


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def new_id() -> str:
    return f"s{uuid.uuid4().hex}"


def bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    """The same for a term on the driver."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions."""
    return sorted(int(n[:-5]) for n in scratch.names(spark, f"{path}/manifests") if n.endswith(".json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """A version, or else the last; none if there is none."""
    if version is None:
        found = versions(spark, path)
        if not found:
            return None
        version = found[-1]
    known = json.loads(scratch.text(spark, f"{path}/manifests/{version:012d}.json"))
    return Manifest(**known | {"segments": tuple(Segment(**s | {"empty": tuple(s["empty"])}) for s in known["segments"])})


def commit(spark: SparkSession, path: str, manifest: Manifest) -> Manifest:
    """Make the next version of ``manifest``; fails, without harm, if there is one already."""
    manifest = replace(manifest, version=manifest.version + 1, built=time.time_ns() // 1_000_000)
    if not scratch.put(spark, f"{path}/manifests/{manifest.version:012d}.json", json.dumps(asdict(manifest))):
        raise Conflict(f"version {manifest.version} of {path} is there already")
    return manifest


@dataclass(frozen=True)
class Snapshot:
    """One version of the index under ``path``, for as long as the reader wants it."""

    spark: SparkSession
    path: str
    manifest: Manifest

    @property
    def segments(self) -> list[Segment]:
        return [s for s in self.manifest.segments if not s.delta]

    def table(self, name: str, segments: Sequence[Segment] | None = None) -> DataFrame:
        """Rows of a table in some segments, with ``segment``."""
        segments = [s for s in (self.segments if segments is None else segments) if name not in s.empty]
        if not segments:
            return self.spark.createDataFrame([], f"{SCHEMAS[name]}, segment string, bucket int")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={s.id}" for s in segments])

    def live(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows(segment, seq, ...)`` whose record is not deleted: by one bit each, in words of 64."""
        deltas = [s for s in self.manifest.segments if s.delta]
        if not deltas:
            return rows
        dead = self.table("deletions", deltas).groupBy(F.col("of").alias("segment"), "word").agg(F.bit_or("bits").alias("bits"))
        bit = F.getbit(F.col("bits"), F.col("seq").bitwiseAND(F.lit(63)).cast("int"))
        rows = rows.withColumn("word", F.shiftright("seq", 6)).join(dead, ["segment", "word"], "left")
        return rows.where(F.col("bits").isNull() | (bit == 0)).drop("word", "bits")

    def pruned(self, name: str, column: str, values: Sequence[str], segments: Sequence[Segment] | None = None) -> DataFrame:
        """Rows with some values of the column that buckets are dealt by: folders are pruned, and the values reach the scan."""
        segments = self.segments if segments is None else segments
        rows = self.table(name, segments)
        held = F.lit(False)
        for n in sorted({s.buckets for s in segments}):
            folders = sorted({bucket_of(v, n) for v in values})
            at = F.col("bucket").isin(folders)
            ids = [s.id for s in segments if s.buckets == n]
            held = held | (at if len(ids) == len(segments) else at & F.col("segment").isin(ids))
        return rows.where(held & F.col(column).isin(list(values)))


def opened(spark: SparkSession, path: str | Snapshot, version: int | None = None, ttl_seconds: float | None = None, now_ms: int | None = None) -> Snapshot | None:
    """The last version of an index, or a given one; none if there is none or, with a time to live, it is older than that."""
    if isinstance(path, Snapshot):
        return path
    found = read(spark, path, version)
    if found is None or (ttl_seconds and (time.time_ns() // 1_000_000 if now_ms is None else now_ms) - found.built > ttl_seconds * 1000):
        return None
    return Snapshot(spark, path, found)


def vacuumed(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the last ``keep`` versions and the files that none of the kept ones names; which segments went.

    Files of a writer that has not committed yet are not told from those of a failed one: run it between writes.
    """
    found = versions(spark, path)
    for v in found[:-keep]:
        scratch.delete(spark, f"{path}/manifests/{v:012d}.json")
    named = {s.id for v in found[-keep:] for s in read(spark, path, v).segments}
    gone = set()
    for name in TABLES:
        for folder in scratch.names(spark, f"{path}/{name}"):
            if folder.startswith("segment=") and folder[8:] not in named:
                scratch.delete(spark, f"{path}/{name}/{folder}")
                gone.add(folder[8:])
    return sorted(gone)
