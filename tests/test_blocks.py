"""Searches that read only the blocks of records that may hold a best row."""

import random

import pytest

from sparkseek.operators import blocks as B
from sparkseek.operators import index as I
from sparkseek.operators import saved as D
from sparkseek.operators import search as S
from sparkseek.sources.corpus import mock

COMMON = ["the", "and", "ring", "on", "café", "blue"]
RARE = [f"w{i}" for i in range(40)]


def rows_of(rng, n, at=0):
    say = lambda k: " ".join(rng.choice(COMMON if rng.random() < 0.5 else RARE) for _ in range(k))
    length = lambda: rng.choice([3, 9, 30]) if rng.random() < 0.98 else 400
    rows = [{"seq": i, "id": f"r{at + i}", "heading": say(rng.randrange(4)), "body": say(length()), "label": rng.choice([None, "ring", "blue on"]), "breadcrumb": rng.choice([None, "", "the ring"]), "type": "file"} for i in range(n)]
    rows[7] |= {"heading": None, "body": None, "label": "ring"}
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """An index of two segments, some of whose records are deleted."""
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("blocks") / "ix")
    keep = ["seq", "id", "heading", "body", "label", "breadcrumb", "type"]
    I.save(mock(spark, rows_of(rng, 3000)).select(*keep), path, buckets=2)
    I.add(spark, path, mock(spark, rows_of(rng, 1500, 3000)).select(*keep), buckets=4)
    I.remove(spark, path, spark.createDataFrame([(f"r{i}",) for i in range(0, 4500, 11)], "id string"))
    return I.load(spark, path).persist(), path


CASES = [("the", {}), ("and the", {}), ("the w3", {}), ("ring ring", {}), ("ring", {}), ("blue on", {}), ("the and café", {}), ("on", {})]
CASES += [("the and", {"scoring": s}) for s in ("bm25", "bm25f")] + [("ring w5", {"scoring": "bm25f", "bm25f_always": True}), ("ring the", {"scoring": "bm25f", "bm25f_always": True}), ("café", {"scoring": "bm25"}), ("the", {"weights": {"body": -1.0}})]


@pytest.mark.parametrize(("query", "knobs", "limit"), [(*c, 12) for c in CASES] + [("and the", {}, 1)])
def test_blocks_give_the_rows_of_the_scan(spark, corpus, query, knobs, limit):
    records, path = corpus
    assert D.search(spark, path, query, limit=limit, **knobs).collect() == S.search(records, query, limit=limit, **knobs).collect()


@pytest.mark.parametrize(("query", "by", "knobs"), [("the", D.matched, {}), ("and the", D.matched, {}), ("w3", D.weighted, {"scoring": "bm25f"})])
def test_common_words_skip_blocks(spark, corpus, query, by, knobs):
    _, path = corpus
    found = D.best(spark, path, query, S.Options(limit=5, **knobs), by)
    assert found.blocks == 36 and 0 < found.read < found.blocks


def test_no_row_is_above_the_bound_of_its_block(spark, corpus):
    _, path = corpus
    at = D.opened(spark, path)
    for q in ("and the", "ring w3"):
        for scoring in ("classic", "bm25"):
            opts, terms = S.Options(scoring=scoring), q.split()
            bounds = B.direct_bounds(B.blocks(at, terms), D._heads(at, q), terms, opts, lambda q=q, t=terms: D.statistics(spark, at, [q, *t]))
            rows = D.matched(spark, at, q, opts).withColumns({"score": B.score(), "block": B.block_of()})
            assert rows.join(bounds, "block", "left").where("bound IS NULL OR score > bound").isEmpty()
        opts = S.Options(scoring="bm25f")
        bounds = B.weighted_bounds(B.blocks(at, terms), terms, opts, D.statistics(spark, at, terms))
        rows = D.weighted(spark, at, q, opts).withColumns({"score": B.score(), "block": B.block_of()})
        assert rows.join(bounds, "block", "left").where("bound IS NULL OR score > bound").isEmpty()


def test_cursors_walk_the_whole_ranking(spark, corpus):
    records, path = corpus
    want, common = ([r.id for r in S.ranked(records, q).collect()] for q in ("w3 w5", "the"))
    got, cursor = [], None
    while True:
        rows, cursor = D.following(spark, path, "w3 w5", cursor, 400)
        got += [r.id for r in rows.collect()]
        if cursor is None:
            break
    assert got == want
    got, cursor = [], None
    for _ in range(3):
        rows, cursor = D.following(spark, path, "the", cursor, 15)
        got += [r.id for r in rows.collect()]
    assert got == common[:45]
    assert D.following(spark, path, "absent")[1] is None
