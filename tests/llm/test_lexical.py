import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkseek.llm import lexical
from sparkseek.llm.lexical import Best, Treaps, counted, ranked_search, term_counts

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    found = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, length = len(found), sum(s for *_, s in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        rows = []
        for d, c, size in found:
            m = 100 - 75 + 75 * size * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def words(rng, n, many=300):
    return " ".join(f"w{int(many * rng.random() ** 3)}" for _ in range(n))


def test_equals_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randrange(0, 60))) for i in range(900)]
    docs += [(2000 + i, "w1 w2 copies of ONE text, w250") for i in range(400)]  # a group of copies, and ties
    docs += [(5, "w7 w7"), (None, "w299 w298 É"), (3001, None), (3002, ""), (3003, "…?!"), (3004, "?!,"), (3005, words(rng, 40_000))]
    items = [(i, words(rng, rng.randrange(1, 30))) for i in range(40)] + [(77, "one ONE text; copies"), (78, None), (79, "nowhere"), (80, "w7"), (80, "w7 w299"), (81, "é É w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("term", F.lit(1)).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    got = lambda: sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search(d, q).collect()), key=str)
    want = plain(docs, items)
    assert got() == want and len(want) > 300
    monkeypatch.setattr(lexical, "PASS_TERMS", 100)
    assert got() == want


def test_blocks_and_pruning():
    rng = random.Random(9)
    vocabulary, best, plainly = 50, Best(10), []
    weights = np.zeros(vocabulary, np.int64)
    terms, w = np.array([0, 3, 44, 49]), np.array([900, 40, 5000, 7])
    weights[terms] = w
    seen = scored = 0
    for block in range(4):
        rows = []
        for i in range(3000):
            held = sorted({int(50 * rng.random() ** 2) for _ in range(rng.randrange(1, 9))})
            rows.append((i * 4 + block, held, [rng.randrange(1, 1000) for _ in held]))
        rng.shuffle(rows)
        flat = lambda k: np.array([x for r in rows for x in r[k]], np.int64)  # noqa: E731, B023
        made = Treaps(np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows]), flat(1), flat(2), vocabulary)
        for t in range(vocabulary):
            stack, found = [(made.root[t], -1, 1 << 40)], []
            while stack:
                v, low, high = stack.pop()
                if v < 0:
                    continue
                assert low < made.doc[v] < high
                found.append(v)
                for side, a, b in ((made.links[0], low, made.doc[v]), (made.links[1], made.doc[v], high)):
                    assert side[v] < 0 or made.impact[side[v]] <= made.impact[v]
                    stack.append((side[v], a, b))
            assert len(found) == sum(t in r[1] for r in rows)
        scored += made.search(terms, w, weights, best)
        seen += len(rows)
        plainly += [(-sum(int(weights[c]) * x for c, x in zip(*r[1:], strict=True)), r[0]) for r in rows]
    want = [x for x in sorted(plainly) if x[0] < 0][:10]
    assert list(zip(-best.score, best.doc, strict=True)) == want and scored < seen / 2


def test_blocks_of_several_batches(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randrange(1, 40))) for i in range(700)]
    items = [(i, words(rng, 9)) for i in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str) == plain(docs, items, 4)


def test_terms_and_empty_tables(spark):
    assert term_counts("Ab aB-AB_ÀÀ1 \x7f~ab".encode()) == (5, Counter({b"ab": 4, "ÀÀ1".encode(): 1}))
    long = b"word, " * 400_000
    assert term_counts(long) == (400_000, Counter({b"word": 400_000}))
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search(d.where("false"), q).collect() == [] == ranked_search(d, q.where("false")).collect()
    assert counted(d, []).first().asDict() == {"doc_id": 1, "n": 2, "codes": [], "tf": []}
