import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm import near_copies as module
from sparkseek.llm.near_copies import near_copies
from sparkseek.llm.simhash import deduplicated

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    """Least id of each component under a Jaccard likeness of 0.8, by all pairs."""
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def test_whole_table_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(DATA).to_pylist()]
    assert {r.doc_id: r.component_id for r in near_copies(spark.read.parquet(DATA)).collect()} == plain_components(rows)


def test_stage_drops_copies_with_a_few_changed_words(spark):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(150), 2):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    want = {d for d, c in plain_components(rows).items() if d == c}
    assert want == set(range(0, 60, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("x"))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_family_of_near_copies_around_the_bound(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            words[at] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    want = plain_components(rows)
    assert 1 < len(set(want.values())) < 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want
    monkeypatch.setattr(module, "PART", 2_000)  # so that buckets are cut into parts
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want


def test_repeated_ids_with_other_texts(spark):
    old, new, lone = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g")
    rows = [(1, old), (2, old), (2, new), (3, new), (5, lone), (5, "h i j k l m n"), (5, lone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in deduplicated(docs).collect())
    assert got == [(1, old), (2, new), (5, lone), (5, "h i j k l m n")]


def test_filter_lets_all_wanted_through_and_little_else(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("text_hash"))
    bits = module._filter(rows.where("text_hash % 4 = 0"))
    h = np.array([r.text_hash for r in rows.collect()], np.int64)
    hit = np.ones(len(h), bool)
    for by in (0, 19, 38):
        at = (h.view(np.uint64) >> np.uint64(by)) & np.uint64(module.FILTER - 1)
        hit &= np.unpackbits(bits, bitorder="little")[at.astype(np.int64)] == 1
    assert hit[h % 4 == 0].all() and hit[h % 4 != 0].mean() < 0.01


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(DATA).where("doc_id < 300")
    want = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    monkeypatch.setattr(module, "_filter", lambda hashes: np.full(module.FILTER // 8, 255, np.uint8))
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want


def test_sets_beside_a_family_cost_few_rows(spark, monkeypatch):
    # 300 close copies of a text, and 300 texts that share most of it but are too far from all: every fingerprint of these
    # meets some of the family. The rows dealt out for exact checks must not grow with all the tables in which they do.
    rng, rows, dealt = random.Random(11), [], []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    for k in range(600):
        words = list(base)
        for at in rng.sample(range(0, 150, 5), 2 if k < 300 else 8):
            words[at] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    want = plain_components(rows)
    assert len(set(want.values())) == 301
    was = module._dealt
    monkeypatch.setattr(module, "_dealt", lambda members, *more: dealt.append(members.count()) or was(members, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want
    assert dealt[0] <= 4 * 600
