import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import quality as Q
from sparkseek.llm import toxicity as T
from sparkseek.llm._fit import labelled, temperature

SF = "/root/testdata/sf0.1"


def area(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("operator", "label", "threshold", "least"), [(Q.quality, "quality", 0.3, 0.98), (T.toxicity, "toxic", 0.5, 0.95)])
def test_held_out_area(tables, operator, label, threshold, least):
    docs, labels = tables
    rows = operator(docs, labels).join(labels.select("doc_id", label), "doc_id", "left").collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r[label] is not None]
    y, s = np.array([r[label] for r in held]), np.array([r.score for r in held])
    assert area(s, y) > least
    assert np.mean((s - y) ** 2) < 0.03


@pytest.mark.parametrize(("operator", "label"), [(Q.quality, "quality"), (T.toxicity, "toxic")])
def test_edge_rows_and_labels(spark, operator, label):
    rows = [(1, "fine words here"), (1, "fine words here"), (2, None), (3, ""), (None, "x " * 200_000), (4, "#### $$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit("a")).withColumn("score", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = operator(docs, none).collect()
    assert len(got) == 6 and len({r.score for r in got}) == 1
    one_sided = spark.createDataFrame([(i, 1, 1) for i in range(40)], none.schema)
    assert {round(r.score, 6) for r in operator(docs, one_sided).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (4, 0, 1), (None, 1, 1)], none.schema)
    assert all(0 <= r.score <= 1 for r in operator(docs, both).collect())
    assert operator(spark.createDataFrame([], docs.schema), both).collect() == []


def test_isotonic_is_monotone_and_close_to_means():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    x, p = T.isotonic(s, y)
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] and p[-1] < 1.01
    assert abs(np.interp(s, x, p).mean() - y.mean()) < 0.02


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    z = T.Trees(rounds=80).fit(x, y).margin(x)
    assert ((z > 0) == y).mean() > 0.95


def test_network_and_temperature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = Q.train(x, y, passes=60)
    assert ((net.probability(x) >= 0.5) == y).mean() > 0.9
    z = np.stack([-x[:, 0] * 3, x[:, 0] * 3], axis=1)
    noisy = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0] * 2))).astype(int)
    assert 2 < temperature(z, noisy) < 5


def test_features_of_texts():
    f = dict(zip(T.FEATURES, T.features("You IDIOT! you st*pid id1ot, s t u p i d?", T.Lexicon()), strict=True))
    assert f["insults"] > 0 and f["second"] > 0 and f["near_second"] > 0 and f["capitals"] > 0.1
    assert f["obfuscated"] > 0 and f["hidden"] > 0 and f["exclaims"] > 0 and f["asks"] > 0
    assert T.features(" ", T.Lexicon()) == [0.0] * len(T.FEATURES)


def test_quality_scores_equal_a_plain_computation(tables):
    """Whole table: the mean vector word by word, then the network entry by entry."""
    docs, labels = tables
    docs = docs.where("doc_id < 400")
    model = Q.fit(docs, labels)
    at, table, net = model.vectors.at, model.vectors.table.astype(float), model.network
    for r in Q.quality(docs, labels, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = Q.tokens(r.text or "")
        n, x = len(words), [0.0] * Q.INPUTS
        if n:
            rows = [table[at[w] if w in at else at.get(Q.shape(w), 0)] for w in words]
            lines = r.text.split("\n")
            again = [sum(a == b for a, b in zip(words, words[d:], strict=False)) / n for d in (1, 2)]
            x = [sum(v[i] for v in rows) / n for i in range(Q.DIM)] + [np.log1p(n) / 10, *again, 1 - len(set(lines)) / len(lines)]
        x = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(v * net.w1[i, j] for i, v in enumerate(x)) + net.b1[j]) for j in range(len(net.b1))]
        z = [(sum(h * net.w2[j, k] for j, h in enumerate(hidden)) + net.b2[k]) / net.t for k in range(2)]
        assert abs(r.score - 1 / (1 + np.exp(np.clip(z[0] - z[1], -700, 700)))) < 1e-3


def test_word_vectors_are_of_all_documents(spark):
    texts = [f"alpha beta{i % 3} gamma {'delta' if i % 2 else 'x'} alpha" for i in range(40)]
    docs = Q._rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(5)
    at = Q._vocabulary(docs)
    got = Q._vectors(at, Q.coded(docs, at))
    count = {}
    for t in texts:
        for w in set(Q.tokens(t)):
            count[w] = count.get(w, 0) + 1
    assert {w for w in got.at if not w.startswith("<")} == {w for w, n in count.items() if n >= 5}
    total = {w: np.zeros(Q.DIM) for w in got.at}
    name = lambda w: w if w in got.at else Q.shape(w)
    for t in texts:
        words = ["<?>", "<?>", *(name(w) for w in Q.tokens(t)), "<?>", "<?>"]
        for i in range(2, len(words) - 2):
            for j in range(i - Q.REACH, i + Q.REACH + 1):
                if i != j:
                    total[words[i]] += Q.random_index(words[j])
    for w in ("alpha", "gamma", "delta", "beta", "x"):
        extra = got.table[got.at[w]] - Q.random_index(w) / np.sqrt(Q.ENTRIES)
        assert np.allclose(extra, total[w] / np.linalg.norm(total[w]), atol=1e-5)


def test_toxicity_scores_equal_a_plain_walk(tables):
    docs, labels = tables
    docs = docs.where("doc_id < 1500")
    model = T.fit(docs, labels)
    xs, ps = model.knots if model.knots else (None, None)
    for r in T.toxicity(docs, labels, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        x, z = T.features(r.text or "", model.lexicon), model.trees.base
        for tree in model.trees.trees:
            while not isinstance(tree, float):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            z += tree
        want = 1 / (1 + np.exp(-z))
        if xs is not None:
            k = int(np.searchsorted(xs, z, side="right"))
            step = ps[0] if k == 0 else ps[-1] if k == len(xs) else ps[k - 1] + (ps[k] - ps[k - 1]) * (z - xs[k - 1]) / (xs[k] - xs[k - 1])
            want = min(1.0, max(0.0, step * (1 - 1e-6) + 1e-6 * want))
        assert abs(r.score - want) < 1e-9


def test_shouting_counts_in_long_plain_texts():
    at = T.FEATURES.index("shouting")
    for text in ("plain words " * 300 + "SHUT UP NOW ÉTÉ A1B OK", "ABC", "ABCd eFG", "quiet", "X- -Y- --- 123 A-B"):
        words = text.split()
        assert T.features(text, T.Lexicon())[at] == sum(len(w) > 2 and w.isupper() for w in words) / len(words)


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = labelled(docs, labels, "quality", 100).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in got) == [(1, "text 0", 1), (2, "other", 0)]


def test_most_frequent_words_are_known(spark, monkeypatch):
    monkeypatch.setattr(Q, "VOCABULARY", 4)
    texts = ["a b c d e"] * 6 + ["a b"] * 3 + ["f a"] * 5 + ["g"] * 4
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert list(Q._vocabulary(docs))[1:5] == ["a", "b", "c", "d"]  # e ties with c and d, f has 5, g has too few


def test_scores_with_a_model_equal_those_of_the_fit(tables):
    docs, labels = tables
    docs = docs.where("doc_id < 300")
    model = Q.fit(docs, labels)
    both = [{r.doc_id: round(r.score, 9) for r in Q.quality(docs, labels, m).collect()} for m in (model, None)]
    assert both[0] == both[1]
