"""Quality: random-indexing word vectors pooled per document, and a two-layer network with calibrated output."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, saved
from ._fit import fold, labelled, temperature, texts

#: Labelled rows for the fit, words of the vocabulary, dimensions, and entries of a word's random index.
FIT_ROWS, VOCABULARY, DIM, ENTRIES, REACH = 8192, 8192, 48, 4, 2
#: Inputs of the network: the pooled vector, the log of the length, and three repetition rates.
INPUTS = DIM + 4
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


def tokens(text: str) -> list[str]:
    """Words in their case, numbers, runs of symbols, and line ends."""
    return _TOKEN.findall(text)


def shape(token: str) -> str:
    """Class of a token outside the vocabulary: its case or kind, and its length up to 12."""
    kind = "9" if token.isdigit() else "#" if not token.isalpha() else "X" if len(token) > 1 and token.isupper() else "x" if token[0].islower() else "Xx"
    return f"<{kind}{min(len(token), 12)}>"


def random_index(word: str) -> np.ndarray:
    """Sparse ternary vector that depends on the word alone."""
    v, seed = np.zeros(DIM, np.float32), np.random.default_rng(zlib.crc32(word.encode("utf-8", "surrogatepass")))
    v[seed.choice(DIM, ENTRIES, replace=False)] = np.repeat(np.float32([1, -1]), ENTRIES // 2)
    return v


class Rows(dict):
    """Row of each token in the table of vectors: its own, or that of its shape. Remembers tokens up to a bound."""

    MOST = 1 << 20

    def __init__(self, at: dict[str, int]):
        super().__init__(at)
        self.at = at

    def __missing__(self, token: str) -> int:
        if len(self) > self.MOST:
            self.clear()
            self.update(self.at)
        row = self[token] = self.at.get(shape(token), 0)
        return row

    def coded(self, text: str) -> tuple[np.ndarray, list[float]]:
        """Rows of the tokens of a text in order; the log of their number, and how many repeat the one before, the one before that, or a line."""
        words = tokens(text)
        n = len(words)
        if not n:
            return np.zeros(0, np.uint16), [0.0] * (INPUTS - DIM)
        lines = text.split("\n")
        again = sum(map(operator.eq, words[1:], words)), sum(map(operator.eq, words[2:], words))
        return np.fromiter(map(self.__getitem__, words), np.uint16, n), [np.log1p(n) / 10, again[0] / n, again[1] / n, 1 - len(set(lines)) / len(lines)]


CODED = "doc_id long, held_out boolean, rows binary, more array<float>"


def coded(docs: DataFrame, at: dict[str, int]) -> DataFrame:
    """``doc_id, held_out, rows, more``: the texts of ``docs(doc_id, held_out, text)`` as rows of the table of vectors, two bytes a token."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(at)
        for batch in batches:
            got = [rows.coded(t) for t in texts(batch.column(2))]
            cells = [pa.array([r.tobytes() for r, _ in got], pa.binary()), pa.array([m for _, m in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["doc_id", "held_out", "rows", "more"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(code, CODED)


@dataclass
class Vectors:
    """Vector of each word or shape: its own index plus the normalised sum of its neighbours' indexes."""

    at: dict[str, int]
    table: np.ndarray

    def pooled(self, rows: np.ndarray, more: list[float]) -> np.ndarray:
        """Mean vector of all tokens, and the other inputs; all zeros for a text without tokens. Long texts go in pieces."""
        total = sum((self.table[rows[i : i + 8192]].sum(axis=0, dtype=np.float64) for i in range(0, len(rows), 8192)), np.zeros(DIM))
        return np.append(total / max(1, len(rows)), more).astype(np.float32)


def _vocabulary(docs: DataFrame) -> dict[str, int]:
    """Row of the words and symbol runs in most of all documents, at least in 5, and of the shapes: each task counts its own first.

    How many words have each count says which counts can be among the most frequent, and only those words are collected.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for t in texts(batch.column(0)):
                count.update(set(tokens(t)))
                if len(count) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["w", "n"])
                    count = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["w", "n"])

    count = saved(docs.select("text").mapInArrow(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n >= 5"))
    have, least = 0, 5
    for n, of_n in sorted(((r.n, r.of_n) for r in count.groupBy("n").agg(F.count("*").alias("of_n")).collect()), reverse=True):
        have, least = have + of_n, n
        if have >= VOCABULARY:
            break
    found = sorted((-r.n, r.w) for r in count.where(F.col("n") > least).collect())
    found += sorted((-r.n, r.w) for r in count.where(F.col("n") == least).orderBy("w").limit(max(0, VOCABULARY - len(found))).collect())
    dropped(count)
    known = ["<?>", *(w for _, w in found), *(f"<{k}{n}>" for k in ("9", "#", "X", "x", "Xx") for n in range(1, 13))]
    return {w: i for i, w in enumerate(known)}


def _vectors(at: dict[str, int], codes: DataFrame) -> Vectors:
    """Word vectors from the contexts of all documents, ``codes(rows)``. Sums are whole numbers, so they agree however rows are dealt."""
    own = np.stack([random_index(w) for w in at])
    # A random index has as many entries of 1 as of -1: the places of each.
    ones = [np.stack([np.flatnonzero(v == s) for v in own]).astype(np.int32) for s in (1, -1)]
    dims = [f"d{i}" for i in range(DIM)]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each task, a row for each word that it met."""
        ends = np.zeros(REACH, np.uint16)  # what stands before, between and after texts
        total, kept, n = np.zeros(len(at) * DIM, np.int64), [ends], 0

        def flush() -> None:
            x = np.concatenate(kept)
            base = x.astype(np.int32) * DIM
            for sign, places in zip((1, -1), ones, strict=True):
                p = places[x]
                for d in range(1, REACH + 1):
                    for to, of in ((base[:-d], p[d:]), (base[d:], p[:-d])):
                        total[:] += sign * np.bincount((to[:, None] + of).ravel(), minlength=len(total))

        for batch in batches:
            for r in batch.column(0):
                kept += [np.frombuffer(r.as_py(), np.uint16), ends]
                n += len(kept[-2])
                if n > 100_000:
                    flush()
                    kept, n = [ends], 0
        flush()
        total[:DIM] = 0  # the ends have no vector but their own
        sums = total.reshape(-1, DIM)
        met = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *(pa.array(sums[met, i]) for i in range(DIM))], ["w", *dims])

    parts = codes.select("rows").mapInArrow(contexts, f"w int, {', '.join(f'{d} long' for d in dims)}")
    got = parts.groupBy("w").agg(*[F.sum(d).alias(d) for d in dims]).toArrow()  # a row for each known word
    total = np.zeros((len(at), DIM), np.float32)
    total[got["w"].to_numpy()] = np.stack([got[d].to_numpy() for d in dims], axis=1)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return Vectors(at, (own / np.sqrt(ENTRIES) + total / np.maximum(norm, 1e-9)).astype(np.float32))


@dataclass
class Network:
    """One hidden layer of rectifiers, then two logits over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    t: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.t
        return 1 / (1 + np.exp(z[:, 0] - z[:, 1]))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, passes: int = 30, batch: int = 128, rate: float = 3e-3) -> Network:
    """Adam on the log loss with weight decay, from a fixed seed."""
    rng = np.random.default_rng(0)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, 2)), np.zeros(2))
    x = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, net.b2]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            a, t = x[order[i : i + batch]], y[order[i : i + batch]]
            h = np.maximum(a @ net.w1 + net.b1, 0)
            z = h @ net.w2 + net.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p /= len(t)
            back = (p @ net.w2.T) * (h > 0)
            step += 1
            for q, g, (m, v) in zip(params, (a.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0)), moments, strict=True):
                g = g + 1e-3 * q
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Model:
    vectors: Vectors | None
    network: Network | None
    prior: float = 0.5

    def scores(self, rows: list[np.ndarray], more: list[list[float]]) -> np.ndarray:
        x = np.array([self.vectors.pooled(r, m) for r, m in zip(rows, more, strict=True)])
        return self.network.probability(x.reshape(len(rows), INPUTS))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return saved(labelled(docs, labels, "quality", FIT_ROWS))


def _prior(picked: DataFrame) -> float | None:
    """The only label, or one half without labels; null if there are both."""
    held = [r.y for r in picked.select("y").distinct().collect()]
    return None if len(held) > 1 else float(held[0]) if held else 0.5


def _fitted(picked: DataFrame, vectors: Vectors) -> Model:
    """Train on the labelled rows, an eighth of which only sets the temperature."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(vectors.at)
        for batch in batches:
            x = [vectors.pooled(*rows.coded(t)).tolist() for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), *batch.columns[1:]], ["x", "y", "doc_id"])

    # Few rows, dealt out over all cores.
    sample = picked.select("text", "y", "doc_id").repartition(picked.sparkSession.sparkContext.defaultParallelism)
    got = sample.mapInArrow(pool, "x array<float>, y int, doc_id long").toPandas().sort_values(["doc_id", "y"], kind="stable")
    y = got["y"].to_numpy(int)
    x = np.stack(got["x"].to_numpy()).astype(float)
    rest = np.arange(len(y)) % 8 == 7
    net = train(x[~rest], y[~rest])
    if rest.sum() >= 50:
        net.t = temperature(net.logits(x[rest]), y[rest])
    return Model(vectors, net)


def _rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most FIT_ROWS labelled rows; word vectors come from all texts."""
    picked, rows = _labelled(docs, labels), _rows(docs)
    if (prior := _prior(picked)) is not None:
        return Model(None, None, prior)
    at = _vocabulary(rows)
    return _fitted(picked, _vectors(at, coded(rows, at)))


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, held_out, score, predicted``.

    ``score`` is the calibrated probability of label 1 from the whole text; null and empty texts get the
    network's value for no tokens. ``labels(doc_id, quality)`` is only read outside the fold (CRC-32 of
    the id modulo 5 is 0); null labels are left out; with no or one-sided labels every score is the share
    of ones (one half without labels). A null ``doc_id`` is not held out. Repeated rows each come back;
    an empty table gives an empty result; further columns are not read. Without a model given, texts are
    taken apart once, and written as the numbers of their tokens, which fit and scores both read.
    """
    rows = _rows(docs)
    if model:
        codes = coded(rows, model.vectors.at) if model.vectors else None
    else:
        picked = _labelled(docs, labels)
        if (prior := _prior(picked)) is not None:
            model = Model(None, None, prior)
        else:
            at = _vocabulary(rows)
            codes = saved(coded(rows, at))
            model = _fitted(picked, _vectors(at, codes))
        dropped(picked)
    if model.network is None:
        return rows.select("doc_id", "held_out", F.lit(model.prior).alias("score"), F.lit(int(model.prior >= threshold)).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores([np.frombuffer(r.as_py(), np.uint16) for r in batch.column(2)], batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return codes.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
