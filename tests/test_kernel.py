"""Literal values of the text kernel, the query language and the search stages."""

import random

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.functions import urls as U
from sparkseek.operators import extract as E
from sparkseek.operators import index as I
from sparkseek.operators import logs as G
from sparkseek.operators import search as S
from sparkseek.plans import querylang as L
from sparkseek.sources.corpus import mock

FOUR = [
    {"id": "/docs#installation", "heading": "Installation Guide", "breadcrumb": "Installation", "body": "Follow these steps to install the package. This installation guide covers all platforms.", "type": "section"},
    {"id": "/docs#pricing", "heading": "Pricing Plans", "breadcrumb": "Pricing", "body": "Compare our pricing plans. Choose the one that fits your needs.", "type": "section"},
    {"id": "/docs#deleting", "heading": "Deleting Your Account", "breadcrumb": "Account", "body": "How to delete your account permanently from the system.", "type": "action", "label": "Delete Account"},
    {"id": "/docs#cafe", "heading": "Café Menu", "breadcrumb": "Menu", "body": "Our café serves coffee and pastries in a cozy atmosphere.", "type": "section"},
]


def one(spark, column, *values):
    names = [chr(97 + i) for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def ids(df):
    return [r.id.split("#")[1] for r in df.collect()]


@pytest.mark.parametrize(("a", "b", "d"), [("kitten", "sitting", 3), ("hello", "hello", 0), ("test", "testing", 3), ("", "test", 4), ("ab", "abc", 1), ("a", "abc", 2), ("ab", "ba", 2)])
def test_levenshtein(spark, a, b, d):
    assert one(spark, F.levenshtein("a", "b"), a, b) == d


def test_four_records(spark):
    rows = mock(spark, FOUR)
    assert ids(S.search(rows, "install"))[0] == "installation"
    assert ids(S.search(rows, "pircing", fuzzy=True)) == ["pricing"]
    assert ids(S.search(rows, "'installation guide'", extended=True)) == ["installation"]
    assert ids(S.search(rows, "installation !guide", extended=True)) == []
    assert set(ids(S.search(rows, "install | pricing", extended=True))) == {"installation", "pricing"}
    assert ids(S.search(rows, "cafe")) == ["cafe"]
    assert ids(S.search(rows, "CAFÉ MENU")) == ["cafe"]
    assert "deleting" in ids(S.search(rows, "delete"))
    assert ids(S.search(rows, "delete", filter=F.col("type") == "section")) == []
    assert ids(S.search(rows, "body:coffee")) == ["cafe"]
    assert ids(S.search(rows, "zzz")) == [] and ids(S.search(rows, " ", limit=2)) == ["installation", "pricing"]
    assert {r.type: r.n for r in I.facets(rows).collect()} == {"section": 3, "action": 1, "field": 0, "link": 0, "file": 0, "media": 0, "structured": 0}


def test_limits_and_pages(spark):
    rows = mock(spark, [{"heading": f"Heading {i}", "body": "x"} for i in range(20)])
    assert S.search(rows, "heading").count() == 8 and S.search(rows, "heading", limit=15).count() == 15
    last = S.page(rows, "heading", cursor="15", size=10).collect()
    assert len(last) == 5 and not last[0].has_more and last[0].next_cursor is None and last[0].total == 20


def test_proximity_equals_all_pairs(spark):
    rng = random.Random(2)
    for _ in range(20):
        tokens = [rng.choice("abcdx") for _ in range(rng.randrange(1, 15))]
        terms = rng.sample("abc", rng.randrange(2, 4))
        gains = []
        for i in range(len(terms)):
            for j in range(i + 1, len(terms)):
                d = [abs(p - q) for p, x in enumerate(tokens) if x == terms[i] for q, y in enumerate(tokens) if y == terms[j]]
                gains += [max(1.0, 2 - min(d) * 0.1)] if d else []
        want = sum(gains) / len(gains) if gains else 1.0
        assert abs(one(spark, X.proximity(F.split("a", " "), terms), " ".join(tokens)) - want) < 1e-12


def test_closest_word_and_suggest(spark):
    rows = mock(spark, [{"heading": "installation", "body": ""}, {"heading": "setup", "body": "reinstall it"}])
    assert S.closest_word(rows, "installtion").first().key == "installation"
    assert S.closest_word(rows, "xyz", 1).collect() == [] and S.closest_word(rows, "a").collect() == []
    assert [r.heading for r in S.suggest(rows, "in").collect()] == ["installation"]


def test_query_tree():
    tree = L.parse("a 'b c' !d ^e f$ | g type:x")
    assert [c.kind for c in tree.children] == ["term", "exact", "exclude", "prefix", "or", "term"]
    assert [c.value for c in tree.children[4].children] == ["f", "g"]
    q = L.parse_fields('title:"big red" type:x type:y "two words" one')
    assert q.fields == {"title": "big red", "type": "y"} and q.terms == ("two words", "one")


def test_urls(spark):
    clean = lambda u: one(spark, U.normalize(F.col("a")), u)
    assert clean("https://a.b/x/?utm_source=1&q=2&a=&ref=z") == "https://a.b/x/?q=2"
    assert clean("https://a.b/") == "https://a.b/" and clean("https://a.b/x/") == "https://a.b/x"
    page = '<link rel="canonical" href="https://c.d/p/?gclid=1">'
    assert one(spark, U.normalize(F.col("a"), F.col("b")), "https://a.b/x", page) == "https://c.d/p"


def test_sections_of_nested_headings(spark):
    pages = spark.createDataFrame([(1, "/n", "<h1><span>Nested <em>Heading</em></span></h1>"), (2, "/t", "<H2 id=\"main\">A</H2><p>text"), (3, "/e", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in E.sections(pages).collect()}
    assert got[1].heading == "Nested Heading" and got[2].selector == "#main" and got[2].body == "text" and 3 not in got


def test_upsert_keeps_one_row(spark):
    rows = mock(spark, [{"id": "a", "heading": "unique heading"}, {"id": "b", "heading": "x"}])
    out = I.updated(rows, rows.where("id = 'a'").withColumn("heading", F.lit("new"))).collect()
    assert sorted((r.id, r.heading, r.seq) for r in out) == [("a", "new", 2), ("b", "x", 1)]
    assert I.updated(rows.limit(0), rows.where("id = 'a'")).first().seq == 0


def test_workflow_parser():
    steps = G.parse_workflow('# c\n- action: type\n  selector: "#a"\n  value: "x y"\n\n- action: wait\n  timeout: 50\n')
    assert steps == [{"action": "type", "selector": "#a", "value": "x y"}, {"action": "wait", "timeout": 50}]


def test_popularity_and_carry(spark):
    log = spark.createDataFrame([(1, "install"), (2, "config"), (3, "install"), (4, "config"), (5, "install"), (6, " ")], "at int, query string")
    assert [(r.query, r.n) for r in G.popular_queries(log, 2).collect()] == [("install", 3), ("config", 2)]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "page_url string, v int")
    new = spark.createDataFrame([("a", 2), ("c", 2)], "page_url string, v int")
    plan = spark.createDataFrame([("a", "keep"), ("b", "drop"), ("c", "add")], "url string, action string")
    assert sorted((r.page_url, r.v) for r in I.carried(old, new, plan).collect()) == [("a", 1), ("c", 2)]


def test_scan_prunes_and_pushes(spark, tmp_path):
    rows = mock(spark, FOUR)
    I.save(rows, str(tmp_path / "ix"), buckets=4)
    plan = I.lookup(spark, str(tmp_path / "ix"), "install")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,install)" in plan
    assert I.lookup(spark, str(tmp_path / "ix"), "install").count() == 1
    best = S.search(I.load(spark, str(tmp_path / "ix")), "install")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in best and "Exchange" not in best


def test_entry_without_the_optional_part(monkeypatch):
    import __spark_entry__ as entry

    assert set(entry._core().queries()) <= set(entry.queries())
    real = entry.importlib.import_module

    def gone(name):
        if name.startswith("sparkseek.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert set(entry.queries()) == set(entry._core().queries()) and set(entry.oracle_sql()) == set(entry._core().oracle_sql())
