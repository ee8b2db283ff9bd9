"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import fold, temperature

#: Orders of the n-grams, and hash bits of each.
ORDERS, BITS = (1, 2, 3), 15
#: Documents that the model is fitted on, for each language at most, and the languages learned: those of most documents.
PER_LANGUAGE, LANGUAGES = 768, 32
#: The stage of the pipeline rejects a document whose likeliest of k languages is under 1 / k and this share of the rest: the model is undecided.
UNSURE = 0.05
SCALE = np.float32(20)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str) -> list[np.ndarray] | None:
    """Hash buckets of the n-grams of a text, one array for each order; None if it has no letter.

    The text is lower-cased, and each run of other characters than letters counts as one space.
    """
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[a]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.where(letter, a, np.uint32(32))[keep]
    space = np.array([32], np.uint32)
    a = np.concatenate([space, a] if a[-1] == 32 else [space, a, space])
    h, out = a, []
    for n in ORDERS:
        if n > 1:
            h = (h[:-1] * np.uint32(0x01000193)) ^ a[n - 1 :]
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the buckets it has and their share of its n-grams of that order."""
    for batch in batches:
        at, share, langs, ids = [], [], [], []
        for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (found := grams(text or "")) is None:
                continue
            got = [np.unique(g, return_counts=True) for g in found]
            at.append(np.concatenate([g[0] + (i << BITS) for i, g in enumerate(got)]).astype(np.int32).tobytes())
            share.append(np.concatenate([g[1] / g[1].sum() for g in got]).astype(np.float32).tobytes())
            langs.append(lang)
            ids.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["doc_id", "lang", "at", "share"])


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # buckets by languages, with IDF, scale and temperature
    bias: np.ndarray

    def score(self, text: str) -> np.ndarray | None:
        """Probabilities of the languages; None for a text without letters."""
        if not self.langs or (found := grams(text)) is None:
            return None
        z = self.bias.copy()
        for i, g in enumerate(found):
            z += self.weight[i][g].sum(axis=0, dtype=np.float64) / len(g)
        p = np.exp(z - z.max())
        return p / p.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, size: int, passes: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Follow-the-regularised-leader with an elastic net: weights (``size`` by ``classes``), mostly zero."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2), 0.0)

    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weights(np.arange(size))


def _picked(known: DataFrame, most: int | None = LANGUAGES) -> DataFrame:
    """``doc_id, lang`` of at most PER_LANGUAGE documents for each of the ``most`` most frequent languages, or of all.

    Those of least id hash: a bound on the hash, set by how many ids a language has, leaves a few thousand of
    each, so nothing but these is ranked, and repeated ids count once.
    """
    spark = known.sparkSession
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("ids"))
    top = counts.orderBy(F.desc("rows"), "lang")
    top = (top if most is None else top.limit(most)).collect()
    bounds = [(r.lang, min(2**63 - 1, (4 * PER_LANGUAGE << 63) // max(1, r.ids))) for r in top]
    bounds = spark.createDataFrame(bounds, "lang string, bound long")
    h = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))
    few = known.join(F.broadcast(bounds), "lang").where(h <= F.col("bound")).select("doc_id", "lang", h.alias("h")).distinct().collect()
    by: dict[str, list] = {}
    for r in few:
        by.setdefault(r.lang, []).append((r.h, r.doc_id))
    rows = [(d, k) for k, found in by.items() for _, d in sorted(found)[:PER_LANGUAGE]]
    return spark.createDataFrame(rows, "doc_id long, lang string")


def _document_counts(known: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents have a letter, and how many hold each bucket: sums of each task, then over tasks."""
    size = len(ORDERS) << BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(size, np.int64), np.zeros(size, bool), 0
        for batch in batches:
            for text in batch.column(0):
                if (found := grams(text.as_py() or "")) is not None:
                    seen[:] = False
                    for i, g in enumerate(found):
                        seen[g + np.uint32(i << BITS)] = True
                    total += seen
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["at", "n"])

    rows = known.select("text").mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket
    found = dict(zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True))
    total = found.pop(-1, 0)
    df = np.zeros(size)
    df[list(found)] = list(found.values())
    return total, df


def fit(docs: DataFrame, most: int | None = LANGUAGES) -> Model:
    """Fit on at most PER_LANGUAGE documents of each of the ``most`` most frequent languages, or of all, outside the held-out fold (2 of 4).

    The weights take 400 kB for each language.

    A tenth of them only sets the temperature. Document frequencies are those of all documents outside the fold
    that have a language. Of rows with the same id and language the least text is learned from.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(4) != 2))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    picked = _picked(known.select("doc_id", "lang"), most)
    # At most PER_LANGUAGE pairs of an id and a language for each language.
    rows = known.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = rows.select("doc_id", "text", "lang").mapInArrow(_counted, "doc_id long, lang string, at binary, share binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["lang"], r["at"]))
    langs = sorted({r["lang"] for r in found})
    size = len(ORDERS) << BITS
    if not langs:
        return Model([], np.zeros((len(ORDERS), 1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([langs.index(r["lang"]) for r in found])
    at = [np.frombuffer(r["at"], np.int32) for r in found]
    total, df = _document_counts(known)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    data = [(np.append(a, size), np.append(np.frombuffer(r["share"], np.float32) * idf[a] * SCALE, np.float32(1))) for a, r in zip(at, found, strict=True)]
    rest = np.arange(len(y)) % 10 != 9
    w = ftrl([d for d, r in zip(data, rest, strict=True) if r], y[rest], len(langs), size + 1)
    held = np.flatnonzero(~rest)
    t = temperature(np.array([data[i][1] @ w[data[i][0]] for i in held]), y[held]) if len(held) >= 20 else 1.0
    weight = (w[:size] * (idf * SCALE)[:, None] / t).astype(np.float32).reshape(len(ORDERS), 1 << BITS, len(langs))
    return Model(langs, weight, w[size] / t)


def languages(docs: DataFrame, model: Model | None = None, most: int | None = LANGUAGES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, ...)``: ``doc_id, held_out, lang_pred, score``.

    Without a model, ``most`` languages are learned, the most frequent ones, or with None all. ``lang_pred`` is the likeliest learned language and ``score`` its calibrated probability, from the
    whole text; ties go to the first language by code point. ``und`` with score 0 is for null texts and
    texts without a letter, and for all if there is nothing to learn from. ``lang`` is only read to fit,
    ``doc_id`` only for the fold; a null id is not held out. Repeated rows each come back; an empty
    table gives an empty result; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, most))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2):
                p = m.score(text.as_py() or "")
                names.append("und" if p is None else m.langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told, with it in ``lang``, if there is such a column of strings.

    Null texts, texts without a letter, and texts for which the languages are as good as even (UNSURE) go; all rows go where there
    is nothing to learn from. What ``lang`` held before is only read to fit. Repeated rows each stay; an empty
    table gives an empty result; all other columns are kept as they are, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")
    to = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = [m.score(t.as_py() or "") for t in batch.column(at)]
            least = 1 / len(m.langs) + UNSURE * (1 - 1 / len(m.langs)) if m.langs else 1
            names = [m.langs[int(x.argmax())] if x is not None and x.max() >= least - 1e-6 else None for x in p]
            columns = list(batch.columns)
            if to is not None:
                columns[to] = pa.array(names, pa.string()).cast(columns[to].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array([n is not None for n in names], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
