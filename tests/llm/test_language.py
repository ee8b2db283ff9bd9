import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkseek.llm import language
from sparkseek.llm.language import BITS, SCALE, Model, fit, ftrl, grams, identified, languages

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(letters.split())} "
    return padded


def test_grams_are_those_of_the_letters():
    for text in ("Añb, c1d!!", "x", "  A\n\nb  ", "ÉÉ 12 é"):
        found = grams(text)
        other = grams(plain_grams(text))
        assert [g.tolist() for g in found] == [g.tolist() for g in other]
        n = len(plain_grams(text))
        assert [len(g) for g in found] == [n, n - 1, n - 2] and max(int(g.max()) for g in found) < 1 << BITS
    assert grams("") is None and grams("12 !? \n") is None


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    rows = [(np.array([c, 3 + rng.integers(0, 50)]), np.array([1.0, 1.0])) for c in y]
    w = ftrl(rows, y, 3, 60, l1=1.0)
    assert all((x @ w[at]).argmax() == c for (at, x), c in zip(rows, y, strict=True))
    assert (w == 0).mean() > 0.5


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet(DATA)
    rows = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(DATA)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = fit(docs), fit(other)
    assert a.langs == b.langs and np.array_equal(a.weight, b.weight)


def test_nulls_empty_long_and_clashing_names(spark):
    model = fit(spark.read.parquet(DATA))
    long = "les queue de la " * 100_000
    rows = [(1, None, "en"), (None, "the and of that", None), (2, "123 !", "fr"), (3, long, "en"), (3, long, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = languages(docs, model).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2)] == [("und", 0.0)] * 2
    assert [r.lang_pred for r in got if r.doc_id == 3] == ["fr", "fr"]
    assert languages(spark.createDataFrame([], docs.schema)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in languages(unlabelled).collect()} == {"und"}
    kept = identified(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "None"]


def test_score_is_the_plain_product():
    text = "Añb c"
    rng = np.random.default_rng(2)
    model = Model(["a", "b"], rng.normal(size=(3, 1 << BITS, 2)).astype(np.float32), np.zeros(2))
    z = sum(np.mean([model.weight[i][k] for k in g.tolist()], axis=0) for i, g in enumerate(grams(text)))
    p = np.exp(z - z.max())
    assert np.allclose(model.score(text), p / p.sum(), atol=1e-5) and SCALE > 0


def test_one_id_in_many_rows_is_learned_once(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    many = spark.range(1000).select(F.lit(4).cast("long").alias("doc_id"), F.concat(F.lit("wort der und "), F.col("id").cast("string"), F.lit(" a")).alias("text"), F.lit("de").alias("lang"))
    picked = language._picked(docs.unionByName(many).where("lang IS NOT NULL")).groupBy("doc_id", "lang").count().collect()
    assert all(r["count"] == 1 for r in picked)
    model = fit(docs.unionByName(many))
    assert model.langs == sorted({r.lang for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()})


def test_document_counts_equal_plain_ones(spark):
    docs = spark.read.parquet(DATA).where("doc_id < 60")
    n, df = language._document_counts(docs.repartition(5))
    want, total = np.zeros(len(language.ORDERS) << BITS), 0
    for r in docs.collect():
        if (found := grams(r.text or "")) is not None:
            total += 1
            for i, g in enumerate(found):
                want[np.unique(g).astype(int) + (i << BITS)] += 1
    assert n == total and np.array_equal(df, want)


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    docs = spark.read.parquet(DATA).withColumn("lang", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    assert len(fit(docs).langs) == 2 and not any(k.startswith("x") for k in fit(docs).langs)


def test_stage_follows_the_model(spark):
    docs = spark.createDataFrame([(1, "the and of that with", None), (2, "der die das und mit", "en"), (3, "zzz", "en"), (4, "12", "en"), (5, None, "en")], "doc_id long, text string, lang string")
    model = fit(spark.read.parquet(DATA))
    assert {(r.doc_id, r.lang) for r in identified(docs, model).collect() if r.doc_id in (1, 2, 4, 5)} == {(1, "en"), (2, "de")}
    turned = Model(model.langs, -model.weight, -model.bias)
    assert {(r.doc_id, r.lang) for r in identified(docs, turned).collect() if r.doc_id < 3} != {(1, "en"), (2, "de")}
    unsure = Model(model.langs, model.weight * 0, model.bias * 0)
    assert identified(docs, unsure).collect() == []
    assert identified(docs, Model([], model.weight[:, :, :0], np.zeros(0))).collect() == []


def test_stage_keeps_every_clean_document(spark):
    docs = spark.read.parquet(DATA.replace("sf0.01", "sf0.1"))
    model = fit(docs)
    want = languages(docs, model).where("lang_pred <> 'und'").count()
    assert identified(docs, model).count() == want
    one = Model(["en"], model.weight[:, :, :1], model.bias[:1])
    assert {r.lang for r in identified(docs.limit(50), one).select("lang").collect()} == {"en"}


def test_languages_by_number_and_without_a_limit(spark):
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèàçñõåø"
    rows = [(i, " ".join([letters[k] * 5, letters[k] * 7, letters[k] * 4]), f"l{k:02}") for i in range(76) for k in [i % 38]]
    docs = spark.createDataFrame(rows * 1, "doc_id long, text string, lang string").withColumn("doc_id", F.col("doc_id") * 1000 + F.crc32(F.col("text")) % 7)
    assert len(language.fit(docs, None).langs) > language.LANGUAGES >= len(language.fit(docs).langs) and len(language.fit(docs, 3).langs) == 3
    numbers = docs.withColumn("lang", F.col("doc_id") % 3)
    assert dict(language.identified(numbers).dtypes)["lang"] == "bigint" and language.identified(numbers).where("lang > 2").count() == 0
