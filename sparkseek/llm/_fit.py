"""Bounded labelled samples and calibration for the classifiers that are trained here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import saved


def fold(n: int) -> Column:
    """CRC-32 of the decimal ``doc_id``, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` documents with a label, ``(doc_id, text, y)``, outside the held-out fold (0 of 5).

    The rows of least id hash are taken, so the sample is the same on every run; only ids and labels
    are sorted, and the few that are picked meet the texts in one join. Of rows with the same id the least
    text counts, so repeated ids don't add rows.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(5) != 0))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).distinct()
    picked = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most ``rows`` ids


def distinct_texts(docs: DataFrame, rows: int) -> DataFrame:
    """``text, h``: about ``rows`` distinct texts of ``docs(text)``, those of least XXH64, or all if they are no more.

    A bound on the hash, set for four fifths of ``rows`` by how many distinct texts there are (to 2 in 100), says which, so
    groups of copies count once, nothing else is dealt out, and no task sorts them.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    found = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0] or 0
    bound = 2**63 - 1 if found <= rows else (rows * 4 // 5 << 63) // found
    return hashed.where(F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= F.lit(bound)).groupBy("h").agg(F.first("text").alias("text")).select("text", "h")


def texts(column: pa.Array) -> Iterator[str]:
    """Texts of an Arrow column, null as empty."""
    return ((x.as_py() or "") for x in column)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Divisor of the logits (rows by classes) that gives the least log loss on ``y``."""
    best, at = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 121):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
        if loss < best - 1e-12:
            best, at = loss, float(t)
    return at
