import numpy as np
from pyspark.sql import functions as F

from sparkseek.llm import ann, embed_dedup
from sparkseek.llm.ann import fit_codebook, nearest, pack, tables
from sparkseek.llm.embed_dedup import quantise, similar_vectors, tile_links, unit_rows

SF = "/root/testdata/{}/embeddings.parquet"


def planted(n=300, d=24, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, d))
    x = np.concatenate([base, *(base + 0.06 * k * rng.normal(size=base.shape) for k in range(1, 5)), base[:n // 6]])
    return x[rng.permutation(len(x))].astype(np.float32)


def plain_links(x, label, threshold=0.98):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = (u @ u.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], *root[hit[i]]) if hit[i].any() else root[i] for i in range(len(x))])
        if (new == root).all():
            return hit.sum(axis=1), root
        root = new


def frame(spark, x, label):
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    x = planted()
    label = np.arange(len(x)) // 200
    n, root = plain_links(x, label)
    got = {r.vec_id: r for r in similar_vectors(frame(spark, x, label)).collect()}
    assert n.sum() > 200
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].kept == (root[i] == i) for i in range(len(x)))


def test_quantisation_bound_holds():
    u = unit_rows(planted().astype(float))
    q, s, e = quantise(u)
    gap = np.abs(u @ u.T - (q @ q.T) * s[:, None] * s[None, :])
    assert (gap <= (1 + e[:, None]) * e[None, :] + e[:, None] + 1e-12).all()
    found = {p for i, j in tile_links(u, u, 0.9) for p in zip(i.tolist(), j.tolist(), strict=True)}
    i, j = np.nonzero(u @ u.T >= 0.9)
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0], 2)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x")).withColumn("n", F.lit(1))
    got = similar_vectors(v).collect()
    assert len(got) == len(rows)
    links = {(r.vec_id, r.n_links, r.component_id) for r in got}
    assert {(1, 3, 1), (2, 3, 1), (None, 3, 1)} <= links
    assert all((i, 0, i) in links for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    empty = spark.createDataFrame([], v.schema)
    assert similar_vectors(empty).collect() == [] and nearest(empty).collect() == []
    near = nearest(v, every=1).collect()
    assert {r.vec_id for r in near if r.query_id == 9} == set()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(near, key=lambda r: r.rank) if r.query_id == 1] == [(1, 2, 2.0), (2, 3, 1.0), (3, 11, 1.0)]


def recall(rows, got, k=20, every=20):
    """Checks ids, ranks, scores and order of what was found, and returns its share of the true neighbours."""
    pdf = rows.toPandas().sort_values("vec_id")
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    at = {v: i for i, v in enumerate(ids.tolist())}
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {v for v in ids.tolist() if v % every == 0}
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, k + 1)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - x[at[q]] @ x[at[r.vec_id]]) <= 1e-12 * max(1, abs(r.score)) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        hits += len({r.vec_id for r in found} & set(ids[np.lexsort((ids, -s))[:k]].tolist()))
    return hits / (k * len(by))


def clustered(n, d, seed, clusters=40):
    """Vectors about centres, of unequal lengths."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.5 * rng.normal(size=(n, d))
    return (x * rng.uniform(0.7, 1.4, (n, 1))).astype(np.float32)


def test_recall_on_the_tables(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = spark.read.parquet(SF.format(sf))
        assert recall(rows, nearest(rows).collect()) >= 0.95


def test_recall_at_several_sizes_and_blocks(spark, monkeypatch):
    for n, d, block, rerank in ((2_000, 64, 16_384, 40), (20_000, 64, 16_384, 320), (20_000, 48, 2_048, 40), (12_000, 32, 512, 10)):
        monkeypatch.setattr(ann, "BLOCK", block)
        x = clustered(n, d, n)
        rows = frame(spark, x, np.zeros(n, int)).repartition(8)
        got = recall(rows, nearest(rows, every=200, rerank=rerank).collect(), every=200)
        assert got >= 0.95, (n, d, block, got)


def test_reranking_all_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    x = clustered(2_000, 24, 5)
    rows = frame(spark, x, np.zeros(len(x), int))
    assert recall(rows, nearest(rows, every=50, rerank=None).collect(), every=50) == 1.0


def test_copies_tie_to_the_least_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:300] = x[100] * 3
    got = [r for r in nearest(frame(spark, x, np.zeros(400, int)), every=100).collect() if r.query_id == 200]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(100, 120))


def test_scan_tables_are_the_inner_products_of_the_decoded_rows():
    x = planted(d=13).astype(float)
    book = fit_codebook(x)
    codes = book.encode(x)
    decoded = np.concatenate([c[codes[:, s]] for s, c in enumerate(book.centres)], axis=1)
    lut, packed = tables(book, x[:5]), pack(codes)
    score = sum(lut[:, b, :][:, packed[:, b]] for b in range(packed.shape[1]))
    assert np.allclose(score, x[:5] @ decoded.T, atol=1e-3)
    assert fit_codebook(planted(d=64).astype(float)).eta > 2
