"""Nearest neighbours by inner product: anisotropic 4-bit product quantisation, table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import saved
from ._vectors import keyed, matrix

#: Vectors that the codebooks are fitted on; components a code covers; rows of a block; queries of a chunk.
FIT_ROWS, WIDTH, BLOCK, CHUNK = 8192, 2, 16_384, 32_768
#: Rows of each block that are reranked for a query, 2 in 100; vectors taking part of this cosine or more shape the loss.
RERANK, NEAR = 320, 0.2
_STRIP = 128


@dataclass
class Codebook:
    """Sixteen centres for each group of components; ``eta`` weighs the residual along the vector."""

    parts: list[np.ndarray]
    centres: list[np.ndarray]
    eta: float

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Code of each group: first the nearest centre, then each in turn by the score-aware loss."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        along = np.zeros(len(x))
        for s, (at, c) in enumerate(zip(self.parts, self.centres, strict=True)):
            codes[:, s] = ((x[:, at][:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            along += ((x[:, at] - c[codes[:, s]]) * unit[:, at]).sum(axis=1)
        for _ in range(sweeps):
            for s, (at, c) in enumerate(zip(self.parts, self.centres, strict=True)):
                left = x[:, at][:, None, :] - c[None]
                par = (left * unit[:, at][:, None, :]).sum(axis=2)
                rest = along - par[np.arange(len(x)), codes[:, s]]
                loss = (left**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + par) ** 2
                codes[:, s] = loss.argmin(axis=1)
                along = rest + par[np.arange(len(x)), codes[:, s]]
        return codes

    def refit(self, x: np.ndarray) -> None:
        """Centres of least score-aware loss for the codes as they are, group by group."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        codes = self.encode(x)
        residual = x.copy()
        for s, at in enumerate(self.parts):
            residual[:, at] -= self.centres[s][codes[:, s]]
        for s, at in enumerate(self.parts):
            own = (residual[:, at] * unit[:, at]).sum(axis=1)
            rest = (residual * unit).sum(axis=1) - own
            for k in range(16):
                m = codes[:, s] == k
                if m.any():
                    u, y = unit[m][:, at], x[m][:, at]
                    lhs = m.sum() * np.eye(len(at)) + (self.eta - 1) * u.T @ u
                    rhs = y.sum(axis=0) + (self.eta - 1) * u.T @ (rest[m] + (y * u).sum(axis=1))
                    self.centres[s][k] = np.linalg.solve(lhs, rhs)
            residual[:, at] = x[:, at] - self.centres[s][codes[:, s]]


def fit_codebook(x: np.ndarray, rounds: int = 3) -> Codebook:
    """k-means in each group of components, then rounds of encoding and refitting under the score-aware loss."""
    d, rng = x.shape[1], np.random.default_rng(0)
    parts = np.array_split(np.arange(d), -(-d // WIDTH))
    centres = []
    for at in parts:
        y = x[:, at]
        c = y[rng.choice(len(y), 16, replace=len(y) < 16)].copy()
        for _ in range(8):
            near = ((y[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(16):
                if (m := near == k).any():
                    c[k] = y[m].mean(axis=0)
        centres.append(c)
    book = Codebook(parts, centres, max(1.0, (d - 1) * NEAR**2 / (1 - NEAR**2)))
    for _ in range(rounds):
        book.refit(x)
    return book


def pack(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, 0::2] * 16 + codes[:, 1::2]


def tables(book: Codebook, q: np.ndarray) -> np.ndarray:
    """For each query and byte of a code: the part of the inner product that each of its 256 values stands for."""
    one = [q[:, at] @ c.T for at, c in zip(book.parts, book.centres, strict=True)]
    if len(one) % 2:
        one.append(np.zeros((len(q), 16)))
    return np.stack([(a[:, :, None] + b[:, None, :]).reshape(len(q), 256) for a, b in zip(one[0::2], one[1::2], strict=True)], axis=1).astype(np.float32)


def _search(books: dict[int, Codebook], k: int, rerank: int | None):
    def best(frame: pd.DataFrame) -> pd.DataFrame:
        """The ``k`` nearest rows of a block for each query of a chunk, with exact inner products."""
        asked, rows = frame[frame["query"]], frame[~frame["query"]]
        out: list[tuple[np.ndarray, ...]] = []
        if len(asked) and len(rows):
            x, q = matrix(rows["embedding"]), matrix(asked["embedding"])
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
            ids, own = rows["ids"].to_list(), asked["vec_id"].to_numpy(np.int64)
            first = np.array([i[0] for i in ids], np.int64)
            take = len(rows) if rerank is None else min(max(rerank, k + 1), len(rows))
            for i in range(0, len(q), _STRIP):
                part = q[i : i + _STRIP]
                lut = tables(books[x.shape[1]], part)
                score = np.zeros((len(part), len(rows)), np.float32)
                for b in range(codes.shape[1]):
                    score += lut[:, b, :].take(codes[:, b], axis=1)
                top = np.argpartition(-score, take - 1, axis=1)[:, :take]
                exact = part @ x.T if take == len(rows) else np.einsum("qd,qkd->qk", part, x[top])
                exact = np.take_along_axis(exact, top, axis=1) if take == len(rows) else exact
                for r in range(len(part)):
                    order = np.lexsort((first[top[r]], -exact[r]))[: k + 1]
                    got = [(s, v) for s, c in zip(exact[r][order].tolist(), top[r][order].tolist(), strict=True) for v in ids[c] if v != own[i + r]]
                    got.sort(key=lambda t: (-t[0], t[1]))
                    out += [(i + r, v, s) for s, v in got[:k]]
        at = np.array([o[0] for o in out], np.int64)
        return pd.DataFrame({"query_id": asked["vec_id"].to_numpy(np.int64)[at], "h1": asked["h1"].to_numpy(np.int64)[at], "h2": asked["h2"].to_numpy(np.int64)[at], "vec_id": np.array([o[1] for o in out], np.int64), "score": np.array([o[2] for o in out], np.float64)})

    return best


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int | None = RERANK) -> DataFrame:
    """For each row of ``vectors(vec_id, embedding, ...)`` with ``vec_id`` divisible by ``every``: its nearest rows.

    Returns ``query_id, rank, vec_id, score``: up to ``k`` other rows of largest inner product, nearest
    first, ties to the smaller id, scores exact on the original vectors. The codebooks are fitted on at most
    FIT_ROWS vectors of each length; every row is encoded, scanned in blocks by table look-ups, and the best
    ``rerank`` rows of each block are computed exactly; with ``rerank=None`` all are, which misses none. Of copies of a vector only the ``k + 1`` of least id can
    be among the nearest of any query, so only those are expanded. Null ids, and vectors that are null, empty,
    zero or hold null or non-finite components, take no part; vectors of other lengths are no candidates.
    Repeated rows count once. An empty table gives an empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    rows = keyed(vectors).where("ok AND vec_id IS NOT NULL").withColumn("dim", F.size("embedding"))
    queries = saved(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h1", "h2"]).select("vec_id", "h1", "h2", "dim", "embedding"))
    once = rows.groupBy("h1", "h2", "vec_id").agg(F.first("embedding").alias("embedding"), F.first("dim").alias("dim"))
    low = once.withColumn("i", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    classes = low.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.first("dim").alias("dim"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = saved(classes)
    per_dim = {r.dim: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asked = {r.dim: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    books: dict[int, Codebook] = {}
    for dim in asked:
        sample = classes.where(F.col("dim") == dim).orderBy("h1", "h2").limit(FIT_ROWS).select("embedding").toPandas()
        books[dim] = fit_codebook(matrix(sample["embedding"]))
    sent = spark.sparkContext.broadcast(books)

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim in sent.value:
                    codes = pack(sent.value[dim].encode(matrix(part["embedding"])))
                    yield part.assign(codes=[c.tobytes() for c in codes])

    def spread(counts: dict[int, int], size: int):
        n = F.lit(1)
        for dim, count in counts.items():
            n = F.when(F.col("dim") == dim, F.lit(-(-count // size))).otherwise(n)
        return n

    kind = classes.schema["embedding"].dataType.simpleString()  # vectors travel as they are stored
    index = classes.mapInPandas(encoded, f"h1 long, h2 long, embedding {kind}, dim int, ids array<long>, codes binary")
    blocks, chunks = spread(per_dim, BLOCK), spread(asked, CHUNK)
    none = lambda kind: F.lit(None).cast(kind)
    data = index.select("dim", F.pmod("h1", blocks).alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(False).alias("query"), none("long").alias("vec_id"), "h1", "h2", "embedding", "ids", "codes")
    ask = queries.select("dim", F.explode(F.sequence(F.lit(0), blocks - 1).cast("array<long>")).alias("block"), F.pmod("h2", chunks).cast("int").alias("chunk"), F.lit(True).alias("query"), "vec_id", "h1", "h2", "embedding", none("array<long>").alias("ids"), none("binary").alias("codes"))
    found = data.unionByName(ask).groupBy("dim", "block", "chunk").applyInPandas(lambda frame: _search(sent.value, k, rerank)(frame), "query_id long, h1 long, h2 long, vec_id long, score double")
    place = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
