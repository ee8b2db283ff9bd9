"""A saved index that changes: segments, deletions, versions, and look-ups by its tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import index as I
from sparkseek.operators import keys as K
from sparkseek.operators import saved as D
from sparkseek.operators import search as S
from sparkseek.operators import segments as G
from sparkseek.sources.corpus import mock

WORDS = ["the", "then", "other", "thin", "thing", "timt", "café", "ring", "rings", "string", "small", "Straße", "b", "ing.", "the."]
COLUMNS = ["seq", "id", "heading", "body", "label", "breadcrumb", "type"]


def rows_of(rng, n, at=0):
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
    return [{"seq": at + i, "id": f"r{at + i}", "heading": say(4), "body": rng.choice(["", " "]) + say(12), "label": rng.choice([None, "ring", "x", "Ring of"]), "breadcrumb": rng.choice([None, "", "on the", "small"]), "type": rng.choice(["file", "link"])} for i in range(n)]


def same(spark, path, searches=("small ring",), every=True):
    """Whether the index answers as a scan of its records does."""
    records = I.load(spark, path)
    for q in searches:
        for scoring in ("classic", "bm25"):
            assert D.search(spark, path, q, limit=30, scoring=scoring).collect() == S.search(records, q, limit=30, scoring=scoring).collect()
    if every:
        assert D.search(spark, path, "thinring", fuzzy=True, limit=30).collect() == S.search(records, "thinring", fuzzy=True, limit=30).collect()
        assert D.search(spark, path, "^the !thing", extended=True, limit=30).collect() == S.search(records, "^the !thing", extended=True, limit=30).collect()
        for w in ("strung", "th"):
            assert D.closest_word(spark, path, w).collect() == S.closest_word(records, w).collect()
        for q in ("th", "ing"):
            assert D.suggest(spark, path, q).collect() == S.suggest(records, q).collect()


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index that was written, added to, deleted from and updated."""
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("grown") / "ix")
    rows = rows_of(rng, 160)
    want = {r["id"]: r for r in rows}
    I.save(mock(spark, rows).select(*COLUMNS), path, buckets=4)
    more = rows_of(rng, 40, 500)
    I.add(spark, path, mock(spark, more).select(*COLUMNS), buckets=2)
    want |= {r["id"]: r for r in more}
    gone = [f"r{i}" for i in range(0, 160, 3)] + ["absent"]
    I.remove(spark, path, spark.createDataFrame([(i,) for i in gone], "id string"))
    for i in gone:
        want.pop(i, None)
    changed = rows_of(rng, 30, 100)
    I.update(spark, path, mock(spark, changed).select(*COLUMNS), buckets=4)
    for r in changed:
        want.pop(r["id"], None)
    want |= {r["id"]: r for r in changed}
    return path, want


def test_changes_are_what_the_records_say(spark, grown):
    path, want = grown
    got = {r.id: r for r in I.load(spark, path).collect()}
    assert {k: (r.heading, r.body, r.label) for k, r in got.items()} == {k: (r["heading"], r["body"], r["label"]) for k, r in want.items()}
    assert sorted(got[f"r{i}"].seq for i in range(100, 130)) == list(range(200, 230))  # changed rows go to the end
    known = I.meta(spark, path)
    assert known["records"] == len(want) and known["version"] == 4
    sums = {(r.field, r.term): r.n for r in I.counts_of(spark, path, [w.lower() for w in WORDS]).collect()}
    every = {(r.field, r.term): r.n for r in I.occurrences(I.load(spark, path)).collect() if r.term in {w.lower() for w in WORDS}}
    assert sums == every
    same(spark, path, ("small ring", "the", "café thin"))


def test_old_versions_stay_and_only_new_files_are_written(spark, grown):
    path, want = grown
    first = G.opened(spark, path, version=1)
    assert I.load(spark, first).count() == 160 and D.total(spark, first, "the").first().total == S.total(I.load(spark, first), "the").first().total
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}
    before = files()
    I.remove(spark, path, spark.createDataFrame([("r101",)], "id string"))
    after = files()
    new = {f[len(path) + 1 :].split("/")[0] for f in after.keys() - before.keys()}
    assert new == {"deletions", "frequencies", "manifests"} and all(after[f] == t for f, t in before.items())
    want.pop("r101")
    same(spark, path, ("small ring",), every=False)


def test_failed_and_rival_writes_do_no_harm(spark, grown):
    path, want = grown
    seen = I.load(spark, path).count()

    def broken(_):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        I.add(spark, path, mock(spark, rows_of(random.Random(1), 5, 900)).select(*COLUMNS), on_index=[broken])
    assert I.load(spark, path).count() == seen
    stale = G.opened(spark, path).manifest
    I.add(spark, path, mock(spark, rows_of(random.Random(1), 1, 950)).select(*COLUMNS))
    with pytest.raises(G.Conflict):
        G.commit(spark, path, stale)
    assert I.load(spark, path).count() == seen + 1
    I.remove(spark, path, spark.createDataFrame([("r950",)], "id string"))


def test_versions_have_a_time_to_live(spark, grown):
    path, _ = grown
    built = G.opened(spark, path).manifest.built
    assert G.opened(spark, path, ttl_seconds=60, now_ms=built + 60_000) is not None
    assert G.opened(spark, path, ttl_seconds=60, now_ms=built + 60_001) is None
    assert G.opened(spark, path + "-none") is None


def test_compaction_and_vacuum(spark, grown):
    path, want = grown
    before = {(r.seq, r.id) for r in I.load(spark, path).select("seq", "id").collect()}
    at = G.opened(spark, path)
    assert I.compact(spark, path, fan=2).segments == at.segments  # no two are of like size
    one = I.compact(spark, path, fan=None)
    assert len(one.manifest.segments) == 1 and one.manifest.records == len(want)
    assert {(r.seq, r.id) for r in I.load(spark, path).select("seq", "id").collect()} == before == {(r.seq, r.id) for r in I.load(spark, at).select("seq", "id").collect()}
    same(spark, path)
    assert len(G.vacuumed(spark, path)) > 4 and len(G.versions(spark, path)) == 1
    same(spark, path, ("small ring",), every=False)
    back = path + "-back"
    I.restored(I.serialized_index(spark, path), back, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in I.load(spark, path).schema))
    same(spark, back, ("small ring",), every=False)


def test_empty_indexes_and_rows_without_words(spark, tmp_path):
    path = str(tmp_path / "ix")
    none = mock(spark, [{"seq": 0, "id": "a", "heading": None, "body": None, "label": "xy"}]).select(*COLUMNS)
    I.save(none.where("false"), path)
    assert D.search(spark, path, "ring").collect() == [] and I.load(spark, path).count() == 0
    I.add(spark, path, none)
    I.remove(spark, path, none.select("id"))
    assert D.search(spark, path, "ring", fuzzy=True, extended=True).collect() == [] == D.suggest(spark, path, "ri").collect()
    assert I.meta(spark, path)["records"] == 0 and G.opened(spark, path).manifest.next_seq == 1


def test_variants_of_near_words_meet(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    assert {"3:0:a", "3:2:c", "4:1:b", "5:2:bc", "1:0:", "2:1:a"} <= set(K.variants("abc"))
    rows = spark.createDataFrame([(w,) for w in set(words)], "term string").select("term", F.struct(F.lit(0).alias("seq"), F.lit(0).alias("pos")).alias("first"))
    heads = spark.createDataFrame([], "seq long, heading string, key string")
    made = {}
    for r in K.neighbours(rows, heads).collect():
        made.setdefault(r.key, set()).add(r.variant)
    assert set(made) == {w for w in words if len(w) >= 3} and all(len(v) == 3 for v in made.values())
    near = spark.createDataFrame([(a, b) for a in made for b in made], "a string, b string").where("levenshtein(a, b) <= 2").collect()
    assert len(near) > len(made) and all(made[r.a] & set(K.variants(r.b)) for r in near)


def test_plans_read_no_bodies(spark, grown):
    path, _ = grown
    for df in (D.closest_word(spark, path, "strung"), D.suggest(spark, path, "thi"), D.suggest(spark, path, "ing")):
        assert "/records" not in df._jdf.queryExecution().toString()
    at = G.opened(spark, path)
    for q in ("thin | timt", "^the", "ing.$", "'small ring'", "label:ring body:thin"):
        found = D._candidates(at, D.parse(q))
        assert found is not None and "/records" not in found._jdf.queryExecution().toString()
        assert {r.seq for r in D.extended(spark, path, q, S.Options()).collect()} == {r.seq for r in S.extended(I.load(spark, path), q, S.Options()).collect()}
    for q in ("!thing", "type:file", "type:file | thin"):
        assert {r.seq for r in D.extended(spark, path, q, S.Options()).collect()} == {r.seq for r in S.extended(I.load(spark, path), q, S.Options()).collect()}


@pytest.mark.parametrize(("q", "d"), [("thintimt", 1), ("thimtimt", 2), ("smal rinf", 2), ("ab", 2), ("cafe", 2), ("ring", 1), ("other thin", 1), (" x", 1)])
def test_fuzzy_through_the_terms_equals_the_scan(spark, grown, q, d):
    path, _ = grown
    pick = lambda rows: {(r.seq, round(r.raw, 9)) for r in rows.collect()}
    assert pick(D.fuzzy(spark, path, q, d, S.Options())) == pick(S.fuzzy(I.load(spark, path), q, d, S.Options()))
