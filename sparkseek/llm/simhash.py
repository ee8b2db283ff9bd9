"""SimHash near-dedup with vantage-point trees over Hamming space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, dropped, saved, word_chunks
from .near_copies import near_copies
from .vptree import balls, plan_tree, route

#: Fingerprints that the top tree is planned from; it only shapes the shards, never the links.
SAMPLE = 16_384
#: Distinct fingerprints a shard should be home to, and the least number of shards.
SHARD_ROWS, MIN_SHARDS = 1 << 20, 16


def simhash64(data: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles of a UTF-8 text; 0 without words."""
    digest, ones, total, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in word_chunks(data.lower()):  # bytes.lower() only touches A-Z
        words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
        h = np.array([digest(b" ".join(g), 42) for g in grams], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
        tail = words[len(words) - shingle + 1 :]
    if not total:
        return digest(b" ".join(tail), 42) if tail else 0
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fps = np.fromiter((simhash64(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


class Forest:
    """Labels of ``n`` nodes under links that come in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        differ = a != b
        if differ.any():
            self.kept.append((a[differ], b[differ]))
            self.size += int(differ.sum())
            if self.size > 1_000_000:
                self.settle()

    def settle(self) -> np.ndarray:
        """Labels so far: the least node of each component."""
        if not self.kept:
            return self.label
        a, b = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        pairs = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in zip((pairs // len(self.label)).tolist(), (pairs % len(self.label)).tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in up:
            to[x] = top(x)
        self.label, self.kept, self.size = to[self.label], [], 0
        return self.label


def link_shard(fps: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """Labels of a shard's fingerprints after linking each to all at home within ``reach`` bits."""
    forest = Forest(len(fps))
    for asked, data in balls(fps, home, reach):
        forest.link(asked, data)
    return forest.settle()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, reach: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, fingerprint, component_id``.

    Rows whose fingerprints differ in at most ``reach`` bits are linked; ``component_id`` is the least
    ``doc_id`` reachable. Equal fingerprints are one class from the start, so copies cost nothing
    beyond their fingerprint. Null and word-less texts have fingerprint zero and are linked like any
    other. Repeated rows each come back. A null ``doc_id`` is ignored in the minimum; a component of
    such rows only has a null ``component_id``. An empty table gives an empty result; further columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = saved(fingerprints(docs))
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = classes.count()
    picked = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"]
    leaves = max(MIN_SHARDS, -(-n // SHARD_ROWS))
    tree = plan_tree(picked.to_numpy(np.int64, copy=True).view(np.uint64), leaves, reach)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = frame["fp"].to_numpy(np.int64, copy=True)
            for leaf, at, home in route(tree, fps.view(np.uint64), reach):
                yield pd.DataFrame({"leaf": np.full(len(at), leaf, np.int32), "fp": fps[at], "home": home})

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy(np.int64, copy=True)
        label = link_shard(fps.view(np.uint64), frame["home"].to_numpy(bool), reach)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": fps[other], "b": fps[label[other]]})

    shards = classes.select("fp").mapInPandas(dealt, "leaf int, fp long, home boolean")
    edges = shards.groupBy("leaf").applyInPandas(linked, "a long, b long")
    roots = components(edges).withColumnRenamed("node", "fp")
    whole = saved(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = saved(whole.groupBy("root").agg(F.min("first").alias("component_id")))
    named = saved(whole.select("fp", "root").join(least, "root").select("fp", "component_id"))
    dropped(classes, whole, least)
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_copies`: that of least ``doc_id``.

    Rows with a null ``doc_id`` only stay where a component has no other, one for each. Of repeated rows
    with the id that stays, one stays for each component. Null and empty texts are one component; an empty table
    gives an empty result; all columns are kept as they are, whatever their names.
    """
    mark, row = _free(docs, "__hash"), _free(docs, "__row")
    names = [f"`{c}`" for c in docs.columns]
    found = near_copies(docs)
    stays = found.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("text_hash").alias(mark), F.count("*").alias("n"))
    stays = saved(stays)
    again = stays.where("n > 1").limit(1).count()
    nameless = saved(found.where("component_id IS NULL"))
    # The ids that stay grow with the corpus, so they are never broadcast: the same plan at every size.
    hashed = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(stays.select("doc_id", mark).hint("merge"), ["doc_id", mark], "left_semi")
    if again:
        kept = kept.dropDuplicates(["doc_id", mark])
    kept = kept.select(*names)
    if nameless.isEmpty():
        return kept
    # Components without any id: rare enough to fingerprint their rows once more, with all columns at hand.
    lone = nameless.select("fingerprint").distinct()
    keyed = docs.where("doc_id IS NULL").withColumn(row, F.xxhash64(*names))
    prints = near_copies(keyed.select(F.col(row).alias("doc_id"), "text"))
    first = prints.join(lone, "fingerprint", "left_semi").where("doc_id = component_id").select(F.col("doc_id").alias(row)).distinct()
    rest = keyed.join(first, row, "left_semi").dropDuplicates([row]).select(*names)
    return kept.unionByName(rest)
