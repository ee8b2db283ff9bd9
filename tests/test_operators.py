"""Operators and hooks against literal values and plain computations."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import extract as E
from sparkseek.operators import index as I
from sparkseek.operators import logs as G
from sparkseek.operators import search as S
from sparkseek.plans.querylang import phonetic_alternatives
from sparkseek.sources import corpus as C
from sparkseek.sources.files import file_documents, is_document
from sparkseek.sources.scratch import folder
from sparkseek.streaming import live as V


def test_rate_limit_equals_the_plain_rule(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.randrange(0, 900_000)) for i in range(600)] + [(1000 + i, "steady", i * 5000) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, ms long").select("event_id", "user_id", F.timestamp_millis("ms").alias("ts")).repartition(5)
    got = {(r.event_id, r.recent) for r in G.rate_limited(events, 2, 60, order=["event_id"]).collect()}
    want, admitted = set(), {}
    for e, u, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        kept = [t for t in admitted.get(u, []) if ms - t < 60_000]
        if len(kept) < 2:
            kept.append(ms)
            want.add((e, len(kept)))
        admitted[u] = kept
    assert got == want and sum(e >= 1000 for e, _ in got) == 8


PAGE = '<h1>T</h1><a href="/in">In</a><a href="https://z.example/">Out</a><form><input id="q" aria-label="Find"></form><button>Delete all</button><div tabindex="0">Go</div><div tabindex="-1">No</div><p contenteditable title="x">Edit</p><span data-act>Mine</span><img src="a.png" alt="Cat"><img src="b.png"><img>'


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://a.example/p", PAGE), (2, "https://a.example/in", "<p>none</p>")], "page_id long, url string, html string")


def test_graph_has_moves_and_effects(pages):
    got = {(r.from_url, r.action, r.to_url, r.effect, r.destructive) for r in E.graph_edges(pages).collect()}
    p = "https://a.example/p"
    assert got == {(p, "T", f"{p}#t", None, None), (p, "In", "https://a.example/in", None, None), (p, "Delete all", None, "dom-action", True), (p, "Find", None, "field-input", None)}


def test_accessible_elements(pages):
    got = [(r.type, r.heading, r.destructive) for r in E.accessible(pages, "data-act").orderBy("page_id", "type", "pos").collect()]
    assert got == [("action", "In", False), ("action", "Out", False), ("action", "Delete all", True), ("action", "Go", False), ("action", "Mine", False), ("field", "Find", False), ("field", "Edit", False)]
    assert "Mine" not in {r.heading for r in E.accessible(pages).collect()}


def test_manifest_of_pages(pages):
    rows = G.manifest(E.page_records(pages), by=["page_id"], exclude=["#q"], navigate_only=True).collect()
    kinds = {(r.type, r.heading) for r in rows}
    assert ("section", "T") in kinds and ("link", "Out") in kinds and ("media", "Cat") in kinds and ("field", "Find") not in kinds
    assert all(r.destructive for r in rows if r.type == "action")
    counts = G.manifest_counts(E.page_records(pages), "page_id").collect()
    assert [(r.page, r.records, r.kept, r.excluded) for r in counts] == [(1, 12, 10, 2)]


def test_images_are_read_where_they_have_no_alternative(pages):
    seen = E.image_texts(pages, lambda src: src.map(lambda s: f" text of {s} " if s else None)).collect()
    assert [(r.src, r.text) for r in sorted(seen, key=lambda r: r.pos)] == [("a.png", "Cat"), ("b.png", "text of b.png")]
    assert [r.text for r in E.image_texts(pages).collect()] == ["Cat"]


def test_crawl_stays_on_the_origin_and_keeps_most(spark):
    link = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [(1, "https://a.example/", link("/b/", "/c?utm_source=1", "https://z.example/q")), (2, "https://a.example/b", link("/", "/d", "/secret/x")), (3, "https://a.example/d", link("/e")), (4, "https://z.example/q", link("/r"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    closed = spark.createDataFrame([("https://a.example", "/secret")], "origin string, path string")
    seeds = pages.where("page_id IN (1, 4)").select("url")
    got = {(r.seed[8], r.url[17:], r.depth) for r in E.crawl(seeds, pages, closed).collect()}
    assert got == {("a", "/", 0), ("a", "/b", 1), ("a", "/c", 1), ("a", "/d", 2), ("a", "/e", 3), ("z", "/q", 0), ("z", "/r", 1)}
    few = {(r.seed[8], r.url[17:]) for r in E.crawl(seeds, pages, closed, most=2).collect()}
    assert few == {("a", "/"), ("a", "/b"), ("z", "/q"), ("z", "/r")}


def test_sitemap_candidates(spark):
    rows = spark.createDataFrame([("https://a.example/x/y",)], "u string")
    get = lambda c: rows.select(E.sitemap_candidates(F.col("u"), c).alias("c")).first().c
    assert get("sitemap.xml") == ["https://a.example/x/sitemap.xml"]
    assert get("/sitemap.xml") == ["https://a.example/sitemap.xml", "https://a.example/x/sitemap.xml"]
    assert get("maps/s.xml") == ["https://a.example/x/maps/s.xml", "https://a.example/x/sitemap.xml"] and get("/s.xml") == ["https://a.example/s.xml"]


def test_files_are_read_by_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1]: (r.type, r.text) for r in file_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("txt", "plain é"), "b.pdf": ("pdf", "")}
    extract = lambda path, data: pd.Series([f"{len(d)} bytes" if d is not None else None for d in data])
    assert {r.text for r in file_documents(spark, str(tmp_path), extract).collect()} == {"plain é", "4 bytes"}
    urls = spark.createDataFrame([("a.PDF?x",), ("a.html",)], "u string")
    assert [r[0] for r in urls.select(is_document(F.col("u"))).collect()] == [True, False]


def test_semantic_search_embeds_heading_and_body(spark):
    rows = C.mock(spark, [{"heading": "aaa", "body": "b"}, {"heading": "b", "body": "bb"}, {"heading": None, "body": "ab"}])
    embed = lambda t: t.map(lambda s: [float(s.count("a")), float(s.count("b"))])
    got = S.semantic_records(rows, "a", embed, 2).collect()
    assert [r.seq for r in got] == [0, 2] and abs(got[0].score - 3 / 10**0.5) < 1e-12


def test_token_filters(spark):
    row = spark.createDataFrame([("The cafés résumé, walking 42",)], "t string")
    get = lambda *f: row.select(X.filtered_tokens(F.col("t"), f).alias("x")).first().x
    assert get() == ["the", "cafés", "résumé", "walking", "42"]
    assert get(X.without(), X.fold, X.stem) == ["caf", "resume", "walk", "42"]
    assert row.select(X.poly_hash(F.col("t"), first=3).alias("h"), X.poly_hash(F.lit("The")).alias("w")).first()[:] == (row.select(X.poly_hash(F.lit("The"))).first()[0],) * 2


def test_workflows(spark):
    steps = spark.createDataFrame([("w", 2, "b", None), ("w", 1, "a", "x"), ("v", 1, "c", None)], "workflow string, step int, action string, value string")
    got = {r.workflow: json.loads(r.json) for r in G.exported(steps).collect()}
    assert got == {"w": {"version": 1, "steps": [{"action": "a", "value": "x"}, {"action": "b"}]}, "v": {"version": 1, "steps": [{"action": "c"}]}}
    one, two = (spark.createDataFrame([(i, a)], "step int, action string") for i, a in ((1, "x"), (1, "y")))
    assert [(r.part, r.action) for r in G.composed(one, two, one).collect()] == [(0, "x"), (1, "y"), (2, "x")]
    contexts = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    assert sorted((r.id, r.action) for r in G.conditional(contexts, F.col("ok"), one, two).collect()) == [(1, "x"), (2, "y"), (3, "y")]
    assert [r.id for r in G.conditional(contexts, F.col("ok"), one).collect()] == [1]
    assert {r.name: json.loads(r.input_schema).get("required") for r in G.tools(spark).collect()}["type"] == ["selector", "value"]


def test_phonetic_alternatives(spark):
    rows = spark.createDataFrame([("Robert",), ("12",)], "term string")
    assert [(r.term, r.alternative) for r in phonetic_alternatives(rows).collect()] == [("Robert", "Robert"), ("Robert", "R163")]


def test_index_hooks_and_clearing(spark):
    records, path, seen = C.mock(spark, [{"heading": "one"}, {"heading": "two"}]), folder(spark), []
    I.save(records, path, on_index=[lambda rows: seen.append(rows.count())])
    assert seen == [2] and I.meta(spark, path)["records"] == 2
    assert I.cleared(spark, path) and not I.cleared(spark, path)


def test_updates_keep_their_order_without_one_window(spark):
    records = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "seq long, id string")
    changes = spark.createDataFrame([(7, "r7"), (200_000, "new"), (2, "r2")], "seq long, id string")
    assert sorted((r.seq, r.id) for r in I.updated(records, changes).collect() if r.seq > 9) == [(10, "r2"), (11, "r7"), (12, "new")]


def stream(spark, rows, schema, plan, tmp_path, **knobs):
    """Rows of a plan over a stream of one file for each list of rows."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    paths = f"{tmp_path}/in*"
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(paths)
    return plan(source)


def test_rescans_in_several_batches(spark, tmp_path):
    base = 10**9  # a watermark begins at time 0
    first = [("p", base + i * 5000) for i in range(20)]
    second = [("p", base + 100_000 + i * 5000) for i in range(20)] + [("q", base + 190_000)]
    plan = lambda s: V.rescans(s.select("url", F.timestamp_millis("ms").alias("ts")), 2, 60)
    out = stream(spark, [first, second], "url string, ms long", plan, tmp_path)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.url, r.ms) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("p", base + t) for t in (0, 5000, 60_000, 65_000, 120_000, 125_000, 180_000, 185_000)] + [("q", base + 190_000)]


def test_quiet_bursts_and_reindexing(spark, tmp_path):
    rows = [[("u", 0), ("u", 100), ("u", 1000), ("v", 50)], [("z", 60_000)]]
    plan = lambda s: V.quiet_bursts(s.select("url", F.timestamp_millis("ms").alias("ts")), "150 milliseconds", "1 second")
    out = stream(spark, rows, "url string, ms long", plan, tmp_path)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.url, r.changes) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("u", 1), ("u", 2), ("v", 1)]


def test_changed_pages_are_extracted_again(spark, tmp_path):
    rows = [[(1, "https://a.example/", "<h1>One</h1>")], [(2, "https://a.example/b", "<h1>Two</h1>")]]
    plan = lambda s: V.reindexed(s, lambda p: E.sections(p).select("page_id", "heading"), f"{tmp_path}/out", f"{tmp_path}/state")
    stream(spark, rows, "page_id long, url string, html string", plan, tmp_path).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.page_id, r.heading) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "One"), (2, "Two")]


def test_cms_answers_as_a_stream(spark, tmp_path):
    rows = [[('[{"id":"a","heading":"A"}]',)], [('{"records":[{"id":"b","heading":"B"}]}',)]]
    out = stream(spark, rows, "payload string", C.cms, tmp_path)
    out.select("id", "heading").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_tracked_queries_are_the_last_ones(spark, tmp_path):
    rows = [[(i, "old" if i < 4 else "a") for i in range(8)], [(i, "b" if i % 2 else " ") for i in range(8, 14)]]
    plan = lambda s: V.tracked(s, f"{tmp_path}/out", f"{tmp_path}/state", 5)
    stream(spark, rows, "at long, query string", plan, tmp_path).trigger(availableNow=True).start().awaitTermination()
    last = V.latest(spark, f"{tmp_path}/out")
    assert sorted((r.at, r.query) for r in last.collect()) == [(6, "a"), (7, "a"), (9, "b"), (11, "b"), (13, "b")]
    assert [(r.query, r.n) for r in G.popular_queries(last, 5).collect()] == [("b", 3), ("a", 2)]


def test_selectors_from_the_most_meaningful(spark):
    html = '<main id="m"><div role="tab" data-testid="go" aria-label="Go">x</div><div class="a b"><button>One</button><button>Two</button></div></main>'
    rows = E.accessible(spark.createDataFrame([(1, "/", html)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [r.selectors for r in rows] == [
        ['[data-testid="go"]', '[aria-label="Go"]', '[role="tab"][aria-label="Go"]', '[role="tab"]', "main#m > div", "xpath=//div[1]"],
        ["main#m > div.a.b:nth-child(2) > button", "xpath=//button[1]"],
        ["main#m > div.a.b:nth-child(2) > button:nth-child(2)", "xpath=//button[2]"],
    ]
