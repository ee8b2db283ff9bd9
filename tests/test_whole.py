"""Queries that must take whole texts and whole tables."""


import unicodedata

from pyspark.sql import functions as F

from sparkseek.functions import text as X
from sparkseek.operators import index as I
from sparkseek.operators import search as S
from sparkseek.plans.catalogue import queries
from sparkseek.sources.corpus import mock

SF = "/root/testdata/sf0.001"


def test_slugs_go_past_80_characters(spark):
    rows = queries()["slugs"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert any(len(r.text) > 1000 for r in rows)
    assert all(r.slug[-1:] == ("-" if not r.text.lower()[-1:].isascii() or not r.text.lower()[-1:].isalnum() else r.text.lower()[-1]) for r in rows if r.text)


def test_facets_count_every_record(spark):
    got = {r.type: r.n for r in queries()["facets"](spark, SF).collect()}
    assert sum(got.values()) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got["media"] > 0 and got["structured"] > 0


def test_facets_shows_absent_types_as_zero(spark):
    got = {r.type: r.n for r in I.facets(mock(spark, [{"type": "file"}, {"type": "file"}])).collect()}
    assert got == {t: 2 if t == "file" else 0 for t in X.TYPES}


def test_fold_covers_every_letter_whose_decomposition_is_one_and_marks(spark):
    chars = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i <= 0xDFFF and unicodedata.normalize("NFD", chr(i)) != chr(i)]
    plain = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F) for c in chars}
    chars = [c for c in chars if len(plain[c]) == 1]
    assert {"ế", "ά", "й"} <= set(chars)
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", X.fold(F.col("c")).alias("f")).collect()
    assert {r.c: r.f for r in rows} == {c: plain[c] for c in chars} == {c: X.fold_text(c) for c in chars}
    text = unicodedata.normalize("NFD", "tiếng Việt ά café")
    assert spark.createDataFrame([(text,)], "c string").select(X.fold(F.col("c")).alias("f")).first().f == "tieng Viet α cafe"


def test_search_finds_vietnamese_and_decomposed_words(spark):
    rows = mock(spark, [{"id": "a", "body": "học tiếng Việt"}, {"id": "b", "body": unicodedata.normalize("NFD", "café au lait")}, {"id": "c", "body": "한국어 문서"}])
    for query, want in [("tiếng", "a"), ("tieng", "a"), ("café", "b"), ("cafe", "b"), ("한국어", "c")]:
        assert [r.id for r in S.direct(rows, query, S.Options()).collect()] == [want]
