import collections
import re

import corpus_pipeline
from sparkseek.llm.language import grams, languages
from sparkseek.llm.pii import base_spans
from tests.llm.test_near_copies import plain_components

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        held[name] = docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert list(held) == ["language_id", "near_dedup", "personal_data", "mixing", "packing"]
    first = held["language_id"].collect()
    assert {r.doc_id for r in first} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if grams(r.text or "")}
    kept = {r.doc_id for r in held["near_dedup"].collect()}
    assert kept == {d for d, c in plain_components([(r.doc_id, r.text) for r in first]).items() if d == c} and len(kept) < len(first)
    clean = {r.doc_id: r for r in held["personal_data"].collect()}
    assert set(clean) == kept
    assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in clean.values())
    mixed = collections.Counter(r.doc_id for r in held["mixing"].collect())
    assert set(mixed) <= kept and max(mixed.values()) <= 3
    packed = held["packing"].collect()
    assert collections.Counter(r.doc_id for r in packed) == mixed
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", clean[r.doc_id].text)) for r in packed)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot"] and out.count() > 100


ODD = "doc_id long, text string, lang string, source string, n_chars int, size int, bucket string, __hash string, __row int, n_tokens long"


def odd(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "b", "h", 2, None) for r in rows], ODD)


def test_stages_keep_clashing_columns_nulls_and_repeats(spark):
    texts = [t for t in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 300 AND 900").orderBy("doc_id").limit(4).select("text").toPandas()["text"]]
    rows = [(1, texts[0], "en", "s"), (1, texts[0], "en", "s"), (2, None, "en", None), (None, " ".join(reversed(texts[1].split())), None, "s"), (3, "", "en", "t"), (4, "12 34", None, None), (5, texts[2] + " mail a.b@mail.org", "en", None), (6, texts[3], "en", "s"), (9, texts[0], "fr", "t")]
    docs = odd(spark, rows)
    learn = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    docs = docs.unionByName(odd(spark, [(r.doc_id + 100_000, r.text, r.lang, r.source) for r in learn]))
    said = {r.doc_id: r.lang_pred for r in languages(docs).where("doc_id < 100").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        kept[name] = docs.where("doc_id IS NULL OR doc_id < 100").collect()
        assert docs.columns == [c.split()[0] for c in ODD.split(", ")]
        assert all(r["__hash"] == "h" and r["__row"] == 2 and r.bucket == "b" and r["size"] == 1 for r in kept[name])
    assert sorted(str(r.doc_id) for r in kept["language_id"]) == ["1", "1", "5", "6", "9", "None"]
    assert all(r.lang == said[r.doc_id] for r in kept["language_id"] if r.doc_id)
    assert sorted(str(r.doc_id) for r in kept["near_dedup"]) == ["1", "5", "6", "None"]
    assert [r.text for r in kept["personal_data"] if r.doc_id == 5] == [texts[2] + " mail [EMAIL]"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id < 100").collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept["mixing"] if r.doc_id}


def test_stages_on_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, []), SF).collect() == [], name
