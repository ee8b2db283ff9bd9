"""Embedding near-dedup: int8 tile products with error bounds, exact where a pair may reach the threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, dropped, saved
from ._vectors import keyed, matrix
from .simhash import Forest

#: Vectors of a block; a tile holds two blocks. A vector goes, as it is stored, to as many tiles as its label has blocks.
BLOCK = 16_384
_STRIP = 128


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers up to 127, their step, and the exact length of what the rounding left of each row."""
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None])
    return q, step, np.linalg.norm(unit - q * step[:, None], axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float):
    """Yields ``(i, j)`` index arrays of the rows of unit matrices with cosine of at least ``threshold``.

    With x = s q + e and y likewise, x.y differs from s_x s_y q_x.q_y by at most (1 + |e_x|) |e_y| + |e_x|.
    Products of whole numbers are exact in single precision up to 2^24. Only pairs whose upper bound
    reaches the threshold are computed in double precision.
    """
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qa, qb = qa.astype(kind), np.ascontiguousarray(qb.astype(kind).T)
    for i in range(0, len(a), _STRIP):
        k = slice(i, i + _STRIP)
        upper = (qa[k] @ qb) * sa[k, None] * sb[None, :] + (1 + ea[k, None]) * eb[None, :] + ea[k, None]
        x, y = np.nonzero(upper >= threshold - 1e-6)
        if not len(x):
            continue
        if 8 * len(x) > upper.size:
            exact = (a[k] @ b.T)[x, y]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", a[i + x[c : c + 65536]], b[y[c : c + 65536]]) for c in range(0, len(x), 65536)])
        hit = exact >= threshold
        if hit.any():
            yield i + x[hit], y[hit]


def _tile(threshold: float):
    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of each class in a tile, counted with copies, and the class that stands for its local component."""
        first = int(frame["i"].iloc[0])
        same = first == int(frame["j"].iloc[0])
        unit, n, node = unit_rows(matrix(frame["embedding"])), frame["n"].to_numpy(np.int64), frame["node"].to_numpy(np.int64)
        left = np.flatnonzero(frame["block"].to_numpy() == first)
        right = left if same else np.flatnonzero(frame["block"].to_numpy() != first)
        links, forest = np.zeros(len(frame), np.int64), Forest(len(frame))
        for i, j in tile_links(unit[left], unit[right], threshold):
            i, j = left[i], right[j]
            if same:
                i, j = i[i != j], j[i != j]
            links += np.bincount(i, n[j], len(frame)).astype(np.int64)
            if not same:
                links += np.bincount(j, n[i], len(frame)).astype(np.int64)
            forest.link(i, j)
        label, hit = forest.settle(), links > 0
        return pd.DataFrame({"node": node[hit], "links": links[hit], "to": node[label[hit]]})

    return linked


def similar_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label, ...)``: ``vec_id, n_links, component_id, kept``.

    Rows of equal label and length are linked at a cosine of at least ``threshold`` in double precision.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the least ``vec_id`` reachable,
    ``kept`` says whether that is the row's own. Copies of a vector are one class that is compared once;
    tiles return counts and a spanning forest, never pairs. Null labels, and vectors that are null, empty,
    zero or hold null or non-finite components, link with nothing. Repeated rows are rows of their own,
    linked with each other. A null ``vec_id`` is ignored in the minimum. An empty table gives an empty
    result; further columns are not read.
    """
    rows = keyed(vectors, "label")
    valid = rows.where("ok").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = saved(valid.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    sizes = saved(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("label", "dim", "node", "n", "block", "embedding", other)
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "embedding")
    found = saved(dealt.groupBy("label", "dim", "i", "j").applyInPandas(_tile(threshold), "node long, links long, to long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = classes.select("node", "h1", "h2", "first", "n").join(links, "node", "left").join(roots, "node", "left")
    whole = saved(whole.select("h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root")))
    least = saved(whole.groupBy("root").agg(F.min("first").alias("component")))
    named = saved(whole.join(least, "root").select("h1", "h2", "links", "component"))
    dropped(found, whole, sizes, least)
    light = saved(rows.select("vec_id", "ok", "h1", "h2"))
    joined = light.where("ok").join(named, ["h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = light.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same links and components in DuckDB, over all pairs of a label, for tables of unique ids.
SIMILAR_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e
      WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98::DOUBLE),
r AS (SELECT a AS node, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node),
d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(d.links, 0)::BIGINT AS n_links, coalesce(c.low, e.vec_id) AS component_id, coalesce(c.low, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN d ON d.a = e.vec_id
"""
