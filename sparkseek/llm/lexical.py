"""Ranked lexical search: inverted treaps by block of documents, walked by all terms of an item at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, saved, word_chunks

#: Results of an item.
BEST = 10
#: Distinct terms of the items that are searched in one pass over the documents; more items take more passes.
PASS_TERMS = 1 << 18
#: Documents and postings of a block of treaps.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 21
#: Documents of an interval that is scored as a whole, and intervals that are opened at a time.
LEAF, OPENED = 32, 256
#: An id that comes after all others: that of documents without one.
LAST = np.iinfo(np.int64).max

#: Letters A to Z in lower case; the other ASCII characters that are in no term as spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms of a text in UTF-8, and how often each occurs; long texts go in pieces."""
    n, found = 0, Counter()
    for words in word_chunks(text.translate(_FOLD)):
        n += len(words)
        found.update(words)
    return n, found


def asked_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, n`` of ``items(item_id, text)``: rows of one id count together, and null texts have no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                _, found = term_counts(text.as_py() or b"")
                ids += [item] * len(found)
                terms += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["item_id", "term", "n"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``doc_id, n, codes, tf`` of the documents that hold a term: how many, and those of a sorted vocabulary by their place in it."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        for batch in batches:
            ids, sizes, codes, tfs, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                n, found = term_counts(text.as_py() or b"")
                if not n:
                    continue
                held = [(code[t], tf) for t, tf in found.items() if t in code]
                ids.append(doc)
                sizes.append(n)
                codes += [c for c, _ in held]
                tfs += [tf for _, tf in held]
                ends.append(len(codes))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (codes, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "codes", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, codes array<int>, tf array<int>")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Best:
    """The best documents of an item so far: highest score first, equal ones by id."""

    k: int = BEST
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def put(self, score: np.ndarray, doc: np.ndarray) -> None:
        if len(self.doc) == self.k:
            hit = score >= self.score[-1]
            score, doc = score[hit], doc[hit]
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]

    def admits(self, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which intervals of ids from ``first``, with scores up to ``bound``, may hold a better document than the last."""
        if len(self.doc) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (first < self.doc[-1]) & (bound > 0))


class Treaps:
    """The postings of a block of documents: for each term a treap, in order of documents by search and of impacts by heap.

    Documents are numbered in order of their ids. Equal impacts are ordered at random, so that many copies of one document
    don't make a treap deep. The postings of each document lie beside each other too, to score it.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, code: np.ndarray, value: np.ndarray, terms: int):
        order = np.argsort(ids, kind="stable")
        start = np.cumsum(sizes) - sizes
        self.ids, size = ids[order], sizes[order]
        self.start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(self.start[-1]) + np.repeat(start[order] - self.start[:-1], size)
        self.code, self.value = code[at], value[at]
        by_term = np.argsort(self.code, kind="stable")
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), size)[by_term]
        self.impact = self.value[by_term]
        ends = np.searchsorted(self.code[by_term], np.arange(terms + 1))
        shuffled = np.random.default_rng(len(ids)).permutation(len(ids))
        self.links, self.root = self._built((self.impact << 24) | shuffled[self.doc], ends[:-1], ends[1:])

    @staticmethod
    def _built(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left and right children of every posting, and the root of every term: the greatest key of a stretch splits it in two, all stretches of a depth at once."""
        links = np.full((2, len(key) + 1), -1, np.int32)
        roots = np.full(len(start), -1, np.int32)
        term = np.flatnonzero(end > start)
        start, end, above, side = start[term], end[term], None, None
        while len(start):
            size = end - start
            first = np.cumsum(size) - size
            at = np.arange(first[-1] + size[-1]) - np.repeat(first - start, size)
            keys = key[at]
            top = at[keys == np.repeat(np.maximum.reduceat(keys, first), size)]
            if above is None:
                roots[term] = top
            else:
                links[side, above] = top
            start, end = np.concatenate([start, top + 1]), np.concatenate([top, end])
            above, side = np.concatenate([top, top]), np.repeat([0, 1], len(top))
            left = end > start
            start, end, above, side = start[left], end[left], above[left], side[left]
        return links, roots

    def scores(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of all documents of some intervals."""
        size = high - low
        docs = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        count = self.start[docs + 1] - self.start[docs]
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) - np.repeat(first - self.start[docs], count)
        return np.add.reduceat(weights[self.code[at]] * self.value[at], first), docs

    def _within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each treap under ``node``, the posting of greatest impact in the interval of its row: a walk down its search order."""
        flat = node.ravel()
        at = np.flatnonzero(flat >= 0)
        row = at // node.shape[1]
        low, high, v = low[row].astype(np.int32), high[row].astype(np.int32), flat[at]
        while len(at):
            doc = self.doc[v]
            below = doc < low
            off = below | (doc >= high)
            at, low, high, v = at[off], low[off], high[off], v[off]
            v = self.links[np.where(below[off], 1, 0), v]
            flat[at] = v
            on = v >= 0
            at, low, high, v = at[on], low[on], high[on], v[on]
        return node

    def search(self, terms: np.ndarray, weight: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Put the best documents of an item into ``best``; how many were scored.

        All treaps of the item are walked together over intervals of documents. An interval whose greatest impacts add up
        to too little is passed over; the others are split at the document of the greatest share of that sum, the most promising
        first, and scored once they are short. ``weights`` holds the weight of each term of the block, 0 for those of other items.
        """
        held = self.root[terms] >= 0
        terms, weight = terms[held], weight[held]
        if not len(terms):
            return 0
        low, high = np.zeros(1, np.int64), np.full(1, len(self.ids))
        node = self.root[terms][None, :]
        bound = (self.impact[node] * weight).sum(1)
        scored = 0
        while True:
            on = best.admits(bound, self.ids[low])
            low, high, node, bound = low[on], high[on], node[on], bound[on]
            if not len(low):
                return scored
            rest = None
            if len(low) > OPENED:
                order = np.argpartition(-bound, OPENED)
                rest = [x[order[OPENED:]] for x in (low, high, node, bound)]
                low, high, node = (x[order[:OPENED]] for x in (low, high, node))
            short = high - low <= LEAF
            whole = ~short
            share = np.where(node[whole] >= 0, self.impact[node[whole]] * weight, -1)
            pivot = self.doc[node[whole][np.arange(len(share)), share.argmax(1)]] if len(share) else np.zeros(0, np.int64)
            score, docs = self.scores(np.concatenate([low[short], pivot]), np.concatenate([high[short], pivot + 1]), weights)
            scored += len(docs)
            some = score > 0
            best.put(score[some], self.ids[docs[some]])
            low, high = np.concatenate([low[whole], pivot + 1]), np.concatenate([pivot, high[whole]])
            node = np.concatenate([node[whole], node[whole]])
            some = high > low
            low, high = low[some], high[some]
            node = self._within(node[some], low, high)
            bound = np.where(node >= 0, self.impact[node] * weight, 0).sum(1)
            if rest is not None:
                low, high, node, bound = (np.concatenate([a, b]) for a, b in zip(rest, (low, high, node, bound), strict=True))


@dataclass
class Program:
    """What the tasks of a pass need: items, their terms and weights, and the sizes of the corpus."""

    items: list[int | None]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    vocabulary: int
    documents: int
    length: int


def _searched(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Program = sent.value
        best = [Best(k) for _ in asked.items]
        weights = np.zeros(asked.vocabulary, np.int64)
        held: list[tuple[np.ndarray, ...]] = []

        def closed() -> None:
            ids, n, sizes, code, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            m = np.array([25 + 75 * int(x) * asked.documents // asked.length for x in n], np.int64)
            block = Treaps(ids, sizes, code, impact(tf, np.repeat(m, sizes)), asked.vocabulary)
            for terms, w, b in zip(asked.terms, asked.weights, best, strict=True):
                weights[terms] = w
                block.search(terms, w, weights, b)
                weights[terms] = 0

        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            codes = batch.column(2)
            sizes = np.diff(codes.offsets.to_numpy())
            flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (codes, batch.column(3))]
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):
                room = (BLOCK_DOCS - sum(len(h[0]) for h in held), BLOCK_POSTINGS - sum(len(h[3]) for h in held))
                start = ends[at] - sizes[at]
                to = max(at + 1, min(at + room[0], int(np.searchsorted(ends, start + room[1]))))
                part = slice(start, ends[to - 1])
                held.append((ids[at:to], batch.column(1).to_numpy()[at:to], sizes[at:to], flat[0][part], flat[1][part]))
                at = to
                if sum(len(h[0]) for h in held) >= BLOCK_DOCS or sum(len(h[3]) for h in held) >= BLOCK_POSTINGS or at < len(ids):
                    closed()
        if held:
            closed()
        rows = [(asked.items[i], None if d == LAST else int(d), int(s)) for i, b in enumerate(best) for s, d in zip(b.score, b.doc, strict=True)]
        cells = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["item_id", "doc_id", "score"])

    return run


def _passed(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the best documents of each task for the items of one pass."""
    spark = docs.sparkSession
    rows = asked.toArrow().to_pydict()
    vocabulary = sorted(set(rows["term"]))
    known = saved(counted(docs, vocabulary))
    total = known.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for code, n in known.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect():  # PASS_TERMS rows at most
        df[code] = n
    of = {t: i for i, t in enumerate(vocabulary)}
    by_item: dict[int | None, list[tuple[int, int]]] = {}
    for item, term, n in zip(rows["item_id"], rows["term"], rows["n"], strict=True):
        if df[of[term]] and (w := weight(total.documents, int(df[of[term]])) * n):
            by_item.setdefault(item, []).append((of[term], w))
    arrays = [tuple(np.array(x, np.int64) for x in zip(*sorted(held), strict=True)) for held in by_item.values()]
    program = Program(list(by_item), [a[0] for a in arrays], [a[1] for a in arrays], len(vocabulary), total.documents, total.length or 1)
    sent = spark.sparkContext.broadcast(program)
    found = saved(known.where(F.size("codes") > 0).mapInArrow(_searched(sent, k), "item_id long, doc_id long, score long"))
    dropped(known)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    ``docs(doc_id, text)`` is searched for the terms of ``items(item_id, text)``. Documents are counted once, by one pass over
    whole texts that keeps the terms of the items only; their postings stay where they were written, and each task makes
    treaps of its documents, block by block, and carries each item's best from one block to the next. Nothing is shuffled but
    ``k`` rows of an item and task. Items of more than :data:`PASS_TERMS` terms together are searched in several passes.

    A null or empty text has no term and counts nowhere. Rows that repeat an id are documents of their own, and may each be
    among an item's best; documents without id come after others of equal score. Rows that repeat an ``item_id`` are one item
    of all their terms; an item without a document of score above 0 has no row. Long texts go in pieces. Empty tables give
    an empty result; further columns are not read.
    """
    asked = saved(asked_terms(items))
    passes = max(1, math.ceil(asked.count() / PASS_TERMS))
    place = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    found = [_passed(docs, asked.where(place == i), k) for i in range(passes)]
    dropped(asked)
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    # Each task gives k rows of an item: a few spans of them first, so that no task ranks those of all tasks.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
SEARCH_SQL = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {_TERMS} AS term FROM w) GROUP BY r, term),
s AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM s),
m AS (SELECT r, 25 + (75 * n * docs) // len AS m FROM s, c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY item_id, term),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
v AS (SELECT item_id, term, times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM q JOIN d USING (term), c),
f AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM v JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM f JOIN w USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {BEST}"""
