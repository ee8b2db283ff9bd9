import collections

from pyspark.sql import functions as F

from sparkseek.llm import mixing
from sparkseek.llm.mixing import mixed, mixture

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return held | {s: level * w[s] for s in free}
        for s in over:
            held[s] = most * sizes[s]
            left -= held[s]
        free -= over
    return held


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(DATA).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise(F.col("source")))
    rows = mixture(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, largest = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixture(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_epochs_are_complete_before_the_part(spark):
    docs = spark.read.parquet(DATA)
    rows = mixture(docs).where("size > 0").collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.target, r.source_size].add(r.taken // r.size)
    assert all(max(c) - min(c) <= 1 for c in by.values())


def test_texts_repeat_as_taken(spark):
    docs = spark.read.parquet(DATA).withColumn("doc", F.lit(1)).withColumn("last", F.lit("x"))
    want = {r.doc_id: r.taken // r.size for r in mixture(docs).collect() if r.size and r.taken}
    out = mixed(docs)
    assert out.columns == docs.columns
    got = collections.Counter(r.doc_id for r in out.where("text <> ''").select("doc_id").collect())
    assert {k: v for k, v in got.items() if k in want} == want and not set(want) - set(got)


def test_nulls_ties_and_empty(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "c d e", None), (3, "", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("target", F.lit("t"))
    got = mixture(docs).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 7
    assert sum(r.taken for r in got if r.doc_id == 1) in (0, 2, 4, 6, 8, 10, 12)
    empty = spark.createDataFrame([], docs.schema)
    assert mixture(empty).collect() == [] and mixed(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "x"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixture(blank).collect()] == [(0, 0.0, 0)] * 2


def test_identical_rows_beyond_the_target_are_taken_in_part(spark):
    rows = [(7, "a " * 19 + "a", "a")] * 4000 + [(i, f"w{i} " * 10, "b") for i in range(10_000, 11_000)] + [(i, f"v{i} " * 10, "c") for i in range(20_000, 22_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixture(docs).collect()
    sizes = {"a": 80_000, "b": 10_000, "c": 20_000}
    taken = collections.Counter()
    for r in got:
        taken["a" if r.doc_id == 7 else "b" if r.doc_id < 20_000 else "c"] += r.taken
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 10, (s, t, taken)
    assert 0 < sum(r.taken > 0 for r in got if r.doc_id == 7) < 4000
    out = collections.Counter(r.doc_id for r in mixed(docs).select("doc_id").collect())
    assert out[7] * 20 == taken["a"] and sum(n for d, n in out.items() if d >= 20_000) * 10 == taken["c"]


def test_crowded_cells_are_cut_again(spark, monkeypatch):
    rows = [(i, "# # # # # a", "low") for i in range(3000)] + [(i, f"plain text {i}", "high") for i in range(5000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = {(r.doc_id, r.taken) for r in mixture(docs).collect()}
    monkeypatch.setattr(mixing, "FEW", 2)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    assert {(r.doc_id, r.taken) for r in mixture(docs).collect()} == whole


def test_no_python_in_the_plans(spark):
    docs = spark.read.parquet(DATA)
    for rows in (mixture(docs), mixed(docs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
