"""Search over a saved index, and fuzzy matching in long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import index as I
from sparkseek.operators import saved as D
from sparkseek.operators import search as S
from sparkseek.sources.corpus import mock
from sparkseek.sources.scratch import folder

WORDS = ["the", "and", "on", "a", "café", "cafe", "résumé", "ring", "small", "Straße", "naïve", "x1"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    rows = [{"seq": i, "id": f"r{i}", "heading": say(4), "body": say(14), "label": rng.choice([None, "ring", "Café", "x", "Ring of"]), "breadcrumb": rng.choice([None, "", "on the", "small"]), "type": rng.choice(["file", "link"])} for i in range(300)]
    rows += [{"seq": 300, "id": "n", "heading": None, "body": None}, {"seq": 301, "id": "e", "heading": "  Ring  ", "body": "\n small\t ring "}]
    records, path = mock(spark, rows), folder(spark)
    I.save(records, path, buckets=4)
    return records, path


QUERIES = ["the", "ring", "small ring", "cafe", "café", "résumé on", "on", "a", "ring ring", "the and on", "x", "x1 naive", "sm", "absent", "strasse", "straße", "r", "  "]
KNOBS = [{"scoring": "bm25"}, {"filter": "type = 'file'"}, {"weights": {"body": 4.0}}, {"scoring": "bm25f"}, {"scoring": "bm25f", "bm25f_always": True}, {"type_weights": {"file": 3.0}}]


@pytest.mark.parametrize(("query", "knobs"), [(q, {}) for q in QUERIES] + [(q, k) for q in ("small ring", "résumé on", "of", "absent") for k in KNOBS])
def test_saved_search_equals_the_scan(spark, corpus, query, knobs):
    records, path = corpus
    want = [tuple(r) for r in S.search(records, query, limit=40, **knobs).collect()]
    assert [tuple(r) for r in D.search(spark, path, query, limit=40, **knobs).collect()] == want


def test_pages_and_totals_equal_the_scan(spark, corpus):
    records, path = corpus
    for cursor in (None, "10", "500"):
        assert [tuple(r) for r in D.page(spark, path, "ring", cursor, 7).collect()] == [tuple(r) for r in S.page(records, "ring", cursor, 7).collect()]
    assert D.total(spark, path, "ring").collect() == S.total(records, "ring").collect()


def test_plans_prune_folders_and_push_terms(spark, corpus):
    _, path = corpus
    plan = D.matched(spark, path, "small ring", S.Options())._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan and "StringStartsWith(key" in plan and "/records" not in plan
    one = D.matched(spark, path, "ring", S.Options())._jdf.queryExecution().executedPlan().toString()
    assert "body" not in one.replace("body_length", "").replace("in_body", "")


def test_least_gap_is_that_of_the_places(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.sample(range(60), rng.randrange(6))), sorted(rng.sample(range(60), rng.randrange(6)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", X.least_gap(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == min((abs(x - y) for x in r.a for y in r.b), default=None) for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_window_distance_equals_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcé 😀") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    for q, d in (("abc", 1), ("ab é", 2), ("😀bca", 2)):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.window_distance(q, d)(F.col("t")).alias("d")).collect()
        for r in got:
            best = min((distance(r.t[i : i + len(q)], q) for i in range(len(r.t) - len(q) + 1)), default=None) if r.t is not None else None
            assert r.d == (best if best is not None and best <= d else None)


def test_long_queries_are_fuzzy_too(spark):
    q = " ".join(f"w{i}" for i in range(80))
    rows = mock(spark, [{"id": "a", "heading": "h", "body": "x " + q.replace("w40", "w41") + " end " + "word " * 9, "label": "l" * len(q)}, {"id": "b", "heading": q[:-1], "body": ""}])
    assert len(q) > 255 and sorted(r.id for r in S.fuzzy(rows, q, 1, S.Options()).collect()) == ["a", "b"]


def test_fuzzy_takes_long_texts_in_stride(spark):
    rows = mock(spark, [{"id": "long", "heading": "h", "body": "lorem ipsum dolor sit amet " * 40_000 + " hotplote"}])
    assert [r.id for r in S.fuzzy(rows, "hotplate", 1, S.Options()).collect()] == ["long"]
    began = time.perf_counter()
    S.fuzzy(rows, "hotplate", 1, S.Options()).collect()
    assert time.perf_counter() - began < 20  # a million characters; a second on an idle machine


def test_detected_language_is_that_of_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = [w for ws in X.LANGUAGE_WORDS.values() for w in ws] + ["Für", "fürs", "xla", "la1", "l_a", "é", "-", "\n", "THE", "theé"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", ".", "é"]) for _ in range(rng.randrange(6))) for _ in range(400)] + [None, ""]
    edge = "(^|[^A-Za-z0-9_]){}([^A-Za-z0-9_]|$)"
    low = F.lower("t")
    n = {k: sum((low.rlike(edge.format(w)).cast("int") for w in ws), F.lit(0)) for k, ws in X.LANGUAGE_WORDS.items()}
    best, want = F.greatest(*n.values()), F.lit("en")
    for k in reversed(list(n)):
        want = F.when((n[k] == best) & (best > 0), F.lit(k)).otherwise(want)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.detect_language(F.col("t")).alias("g"), want.alias("w")).where("t IS NOT NULL").collect()
    assert len({r.g for r in got}) == 4 and all(r.g == r.w for r in got)
