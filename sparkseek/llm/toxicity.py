"""Toxicity: gradient-boosted trees over dense lexicon and style features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import saved
from ._fit import fold, labelled, texts

#: Labelled rows that everything below is fitted on, at most; words and word starts that may be learned.
FIT_ROWS, LEARNED = 16_384, 4096
START = 5

# Insults, and second-person pronouns of the four languages.
INSULTS = frozenset("asshole bastard bitch clown cretin crap damn degenerate disgusting dumb fool freak garbage hate idiot imbecile jerk kill loser lunatic moron nasty parasite pathetic pig rat retard scum shut sick slut stupid suck trash ugly vermin vile whore worthless".split())
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros vuestro".split())

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”‘’–—"
_PLAIN = str.maketrans("013457@$!|*", "oieastasil ")
_LOUD = re.compile(r"(?<!\S)[^a-z\s]{3,}(?!\S)")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!|*]+[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?!\S)")
FEATURES = ("log_words", "insults", "log_insults", "learned", "log_learned", "starts", "log_starts", "second", "near_second", "capitals", "shouting", "exclaims", "asks", "punctuation", "obfuscated", "hidden")


@dataclass
class Lexicon:
    words: frozenset = frozenset()
    starts: frozenset = frozenset()


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The FEATURES of a whole text; densities are per word, all zero for a text without words."""
    words = [w.strip(_PUNCT) for w in text.lower().split()]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    learned = sum(w in lexicon.words for w in words) if lexicon.words else 0
    starts = sum(w[:START] in lexicon.starts for w in words) if lexicon.starts else 0
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = np.searchsorted(second, [i - 4 for i in insults]) < np.searchsorted(second, [i + 5 for i in insults]) if insults and second else []
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    shouting = sum(map(str.isupper, _LOUD.findall(text)))
    odd = _MIXED.findall(text) if count[48:58].any() or count[[33, 36, 42, 64, 124]].any() else []
    hidden = sum(w.translate(_PLAIN) in INSULTS for w in words if not w.isalpha()) if odd else 0
    odd_n = len(odd) + len(_SPACED.findall(text))
    return [
        np.log1p(n), len(insults) / n, np.log1p(len(insults)), learned / n, np.log1p(learned), starts / n, np.log1p(starts),
        len(second) / n, float(np.sum(near)) / n, upper / max(1, upper + lower), shouting / n,
        count[33] / n, count[63] / n, marks / n, odd_n / n, hidden / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, split on quantile bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    least: int = 8
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1], method="lower")) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(bins, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            z += self._walk(tree, x)
        return self

    def _grow(self, bins, cuts, g, h, at, depth):
        leaf = self.rate * g[at].sum() / (h[at].sum() + 1.0)
        if not depth or len(at) < 2 * self.least:
            return float(leaf)
        total, best = (g[at].sum(), h[at].sum()), (1e-6, 0, 0)
        for j in range(bins.shape[1]):
            if not len(cuts[j]):
                continue
            b, k = bins[at, j], len(cuts[j]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[at], h[at], None))
            gain = gs**2 / (hs + 1) + (total[0] - gs) ** 2 / (total[1] - hs + 1) - total[0] ** 2 / (total[1] + 1)
            gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
            if gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[0] <= 1e-6:
            return float(leaf)
        left = bins[at, best[1]] <= best[2]
        return (best[1], float(cuts[best[1]][best[2]]), self._grow(bins, cuts, g, h, at[left], depth - 1), self._grow(bins, cuts, g, h, at[~left], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._walk(tree, x)
        return z


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of ``y`` on ``score`` (pool adjacent violators), smoothed off 0 and 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, least score, greatest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ps = np.array([p for b in blocks for p in [(b[0] + 0.5 * y.mean()) / (b[1] + 0.5)] * 2])
    return xs, np.maximum.accumulate(ps)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float = 0.0

    def scores(self, rows: list[str]) -> np.ndarray:
        if not self.trees.trees:
            return np.full(len(rows), self.prior)
        x = np.array([features(t, self.lexicon) for t in rows]).reshape(len(rows), len(FEATURES))
        z = self.trees.margin(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-z))
        # The margin keeps the order of rows within a step.
        return np.clip(np.interp(z, *self.knots) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-z)), 0.0, 1.0)


def _learn(sample: DataFrame) -> list[Lexicon]:
    """Words, and word starts, that nearly only toxic documents have: of half 0 of the sample, of half 1, and of both.

    Copies count once. Support is at least 3 documents (5 for starts), of which 9 in 10 are toxic.
    """
    once = sample.dropDuplicates(["text"]).select("y", "half", F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " ")).alias("words"))
    each = once.select("y", "half", F.explode("words").alias("w")).where(F.length("w") > 2)
    starts = once.select("y", "half", F.explode(F.array_distinct(F.transform("words", lambda w: F.substring(w, 1, START)))).alias("w")).where(F.length("w") == START)
    parts = {"0": (F.col("t0"), F.col("n0")), "1": (F.col("t1"), F.col("n1")), "both": (F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1"))}

    def top(rows: DataFrame, least: int) -> list[frozenset]:
        sums = [F.sum(F.when(F.col("half") == h, v).otherwise(0)).alias(f"{k}{h}") for h in (0, 1) for k, v in (("t", F.col("y")), ("n", F.lit(1)))]
        fits = {k: (t >= least) & (t >= 0.9 * n) for k, (t, n) in parts.items()}
        count = saved(rows.groupBy("w").agg(*sums).where(fits["0"] | fits["1"] | fits["both"]))
        best = lambda k: count.where(fits[k]).orderBy(parts[k][0].desc(), parts[k][1], "w").limit(LEARNED)
        return [frozenset(r.w for r in best(k).select("w").collect()) for k in parts]

    return [Lexicon(w, s) for w, s in zip(top(each, 3), top(starts, 5), strict=True)]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most FIT_ROWS labelled rows; an eighth of them only calibrates.

    Each half of the rows is measured with the lexicon of the other half, so that the trees do not meet
    words that were learned from the very document; texts are scored with the lexicon of both.
    """
    sample = labelled(docs, labels, "toxic", FIT_ROWS).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(8)))
    sample = saved(sample.withColumn("half", F.col("part") % 2)).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    *halves, lexicon = _learn(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, halves[1 - p % 2]) for t, p in zip(texts(batch.column(0)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["x", "y", "part", "doc_id"])

    got = sample.select("text", "y", "part", "doc_id").mapInArrow(measured, "x array<double>, y int, part long, doc_id long").toPandas()
    got = got.sort_values(["doc_id", "y"], kind="stable")
    y, part = got["y"].to_numpy(float), got["part"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicon, Trees(), None, float(y.mean()) if len(y) else 0.0)
    x = np.stack(got["x"].to_numpy())
    train, rest = part < 7, part == 7
    if rest.sum() < 100 or y[rest].min() == y[rest].max() or y[train].min() == y[train].max():
        return Model(lexicon, Trees().fit(x, y), None)
    trees = Trees().fit(x[train], y[train])
    return Model(lexicon, trees, isotonic(trees.margin(x[rest]), y[rest]))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, held_out, score, predicted``.

    ``score`` is the calibrated probability that the whole text is toxic; null and empty texts are
    scored like a text without any marks. ``labels(doc_id, toxic)`` is only read outside the fold
    (CRC-32 of the id modulo 5 is 0); null labels are left out; with no or one-sided labels every score
    is the share of toxic labels. A null ``doc_id`` is not held out. Repeated rows each come back; an
    empty table gives an empty result; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(list(texts(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
