"""Packing into padded token-budget batches, with optimal length buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import saved, word_count

#: Rows that one ranking window should hold.
SLICE_ROWS = 20_000


def _best_ends(best: np.ndarray, rows: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least ``best[i] + lengths[j] * (rows[j] - rows[i]) - (words[j] - words[i])`` over i < j, and its i.

    The best i does not fall as j grows, so the middle j of every open stretch is settled between the answers
    at its ends, all stretches of a level at once.
    """
    n = len(lengths)
    cost, came = np.zeros(n + 1, best.dtype), np.zeros(n + 1, np.int64)
    lo, hi, least, most = np.array([1]), np.array([n]), np.array([0]), np.array([n - 1])
    while len(lo):
        mid = (lo + hi) // 2
        last = np.minimum(most, mid - 1)
        size = last - least + 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        i = np.arange(size.sum()) - np.repeat(start - least, size)
        j = np.repeat(mid, size)
        value = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (words[j] - words[i])
        cost[mid] = np.minimum.reduceat(value, start)
        hit = np.flatnonzero(value == np.repeat(cost[mid], size))
        at = i[hit[np.searchsorted(hit, start)]]
        came[mid] = at
        left, right = lo < mid, mid < hi
        lo, hi, least, most = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (least[left], at[right]), (at[left], most[right])))
    return cost, came


def optimal_bounds(lengths: Sequence[int], counts: Sequence[int], tokens: Sequence[int], buckets: int) -> list[int]:
    """Bucket bounds, ascending, that minimise the padding of ``counts[i]`` rows of ``lengths[i]``, with ``tokens[i]`` in all.

    One more bucket at a time, over all lengths at once, in whole numbers of 64 bits. Where the greatest length times all rows
    has no place in them, sums are extended floats: exact too, as long as the best padding and its tokens are under 2^64.
    """
    n, lengths = len(lengths), np.asarray(lengths, np.int64)
    if not n:
        return []
    rows, words = (np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in (counts, tokens))
    kind = np.int64 if int(lengths[-1]) * int(rows[-1]) < 1 << 62 else np.longdouble
    lengths, rows, words = (x.astype(kind) for x in (lengths, rows, words))
    best = np.full(n + 1, 1 << 62 if kind is np.int64 else np.inf, kind)
    best[0] = 0
    back: list[np.ndarray] = []
    for k in range(min(buckets, n)):
        if k:
            after, came = _best_ends(best, rows, words, lengths)
        else:
            after, came = np.append(np.zeros(1, kind), lengths * rows[1:] - words[1:]), np.zeros(n + 1, np.int64)
        if k and after[n] >= best[n]:
            break
        back.append(came)
        best = after
    bounds, j = [], n
    for came in reversed(back):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(came[j])
    return bounds[::-1]


def packed(docs: DataFrame, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_tokens, bucket, bucket_len, batch, slot``.

    Tokens are white-space words. At most ``buckets`` length bounds minimise the padding over the global
    histogram, which holds every length that occurs: texts of W words in all have under sqrt(2 W) of them, some
    millions at 100 TB. Inside a bucket every row is padded to ``bucket_len`` and rows fill batches of at most
    ``budget`` padded tokens by length; every batch of a bucket but its last is full. A row longer than
    the budget is a batch of its own. Null and empty texts have length 0 (bounds may be 0; their batches
    hold ``budget`` rows). Repeated rows are packed each; ties in length go by a row number. An empty
    table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("n_tokens"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = (hist[c].to_numpy() for c in ("n_tokens", "n"))
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    bounds = optimal_bounds(lengths, counts, lengths * counts, buckets) or [0]
    total = int(counts.sum())
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(bucket)
    bound = F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), F.col("bucket") + 1)
    slices = max(1, -(-total // SLICE_ROWS))
    rows = rows.withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    sizes = rows.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(sizes.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("bucket", "slice").orderBy("n_tokens", "row")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "slice"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("offset")).withColumn("bucket_len", bound)
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / fit).alias("batch"), (F.col("rank") % fit).cast("int").alias("slot"))
