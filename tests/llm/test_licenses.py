import random

from pyspark.sql import functions as F

from sparkseek.llm.licenses import SHINGLE, SIMILAR, TEMPLATES, anchors, licenses, plan_windows, shingles_of, words_of

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain(text):
    words, out = words_of(text or ""), {}
    grams = [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    for name, c in plan_windows(TEMPLATES).items():
        want = set(shingles_of(words_of(TEMPLATES[name])))
        for at in range(0, len(grams), c.step):
            share = len(want & set(grams[at : at + c.size])) / len(want)
            if share >= SIMILAR:
                best = out.get(name, (0, at))
                out[name] = (max(best[0], share), best[1])
    return {(k, *v) for k, v in out.items()}


def garbled(rng, name):
    words = TEMPLATES[name].split()
    if rng.random() < 0.5 and len(words) > 30:
        words[rng.randrange(len(words))] = "xx"
    return " ".join(words)


def test_equals_every_window(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "license", "software", "of", "the"]) for _ in range(n))
    texts = []
    for i in range(60):
        names = rng.sample(sorted(TEMPLATES), rng.randrange(0, 4))
        texts.append(" ".join([filler(rng.randrange(0, 60)), *(garbled(rng, k) + " " + filler(rng.randrange(0, 9)) for k in names)]))
    texts.append(filler(9000) + " " + TEMPLATES["gpl-3.0-header"] + " " + filler(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license, round(r.containment, 9), r.first_word) for r in licenses(docs).collect()}
    want = {(i, k, round(s, 9), at) for i, t in enumerate(texts) for k, s, at in plain(t)}
    assert got == want and len(want) > 50


def test_plan():
    for name, c in plan_windows(TEMPLATES).items():
        n = len(shingles_of(words_of(TEMPLATES[name])))
        assert c.least <= n <= c.size - c.step and 4096 % c.step == 0
        held = -(-n * 4 // 5)
        likeness = held / (c.size + n - held)
        assert 1 - (1 - likeness) ** c.bands >= 0.998
        assert set(anchors(TEMPLATES[name])) <= set(words_of(TEMPLATES[name]))


def test_no_text_that_holds_a_template_lacks_its_anchors():
    rng = random.Random(2)
    for text in (*TEMPLATES.values(), " ".join(f"w{i}" for i in range(40)), " ".join(f"x{rng.randrange(90)}" for _ in range(700))):
        words, found = words_of(text), set(anchors(text))
        grams = shingles_of(words)
        without = [g for g in grams if not found & set(g.split())]
        assert len(without) < SIMILAR * len(grams) and 0 < len(found) <= len(grams)


def test_long_templates_without_repeated_words(spark):
    rng = random.Random(8)
    whole = {f"t{n}": " ".join(f"{k}x{rng.randrange(10**6)}" for k in range(n)) for n in (30, 40, 300, 1500)}
    texts = []
    for name, t in whole.items():
        words = t.split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "changed"
        texts += ["filler " * 70 + t + " end", " ".join(words), " ".join(words[: len(words) // 2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word) for r in licenses(docs, whole).collect()}
    assert {k for k in got if k[0] % 3 == 0} == {(3 * i, k) for i, k in enumerate(whole)}
    assert all(v[0] == 1.0 for k, v in got.items() if k[0] % 3 == 0) and not any(d % 3 == 2 for d, _ in got)
    assert got == {(r.doc_id, r.license): (round(r.containment, 9), r.first_word) for r in licenses(docs, whole, exact=True).collect()}


def test_no_python_in_the_plan(spark):
    plan = licenses(spark.read.parquet(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (None, "Released under the MIT License."), (2, ""), (3, "mit license"), (4, "RELEASED under the\nMIT license!"), (4, "RELEASED under the\nMIT license!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("grams", F.lit("x"))
    assert sorted((str(r.doc_id), r.license, r.containment, r.first_word) for r in licenses(docs).collect()) == [("4", "mit", 1.0, 0), ("4", "mit", 1.0, 0), ("None", "mit", 1.0, 0)]
    assert licenses(spark.createDataFrame([], docs.schema)).collect() == []
