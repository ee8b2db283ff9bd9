import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkseek.llm.whitening import Fit, block_lanczos, deviations, whitened

DATA = "/root/testdata/sf0.01/embeddings.parquet"


def plain(vectors):
    """Fixed-point rows, mean, eigenvalues and eigenvectors of the distinct ones, all at once."""
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors]
    x = np.array(sorted({tuple(v) for _, v in rows}), np.float64)
    centred = x - x.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return rows, {tuple(map(int, r)) for r in x}, x.mean(0), e[::-1], v[:, ::-1]


def compared(spark, vectors, df, k=16):
    rows, distinct, mean, e, v = plain(vectors)
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    got = whitened(df, k).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) * k and set(by) == {i for i, _ in rows}
    for i, x in rows:
        z = (np.array(x) - mean) @ v[:, :k] / np.sqrt(e[:k])
        mine = np.array([by[i][c].whitened for c in range(1, k + 1)])
        assert np.allclose(np.abs(mine), np.abs(z), atol=1e-6)
        assert all(by[i][c].deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) and by[i][c].n == n for c in (1, k))
    assert np.allclose([by[rows[0][0]][c].explained for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9


def test_equals_a_dense_decomposition(spark):
    df = spark.read.parquet(DATA)
    compared(spark, [(r.vec_id, r.embedding) for r in df.collect()], df.repartition(5))


def test_odd_rows(spark):
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(40)] + [(500, [0.0] * 5)]
    bad = [(200, None), (201, []), (202, [1.0] * 4), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("inf")] * 5), (206, [1e30] * 5)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("a")).withColumn("n", F.lit("b"))
    compared(spark, good, df, 5)
    assert whitened(df, 16).where("component = 6").count() == 0  # as many as there are directions
    assert whitened(df.where("false")).collect() == [] == whitened(df.where("vec_id >= 100 AND vec_id < 140")).collect()
    twice = whitened(df.where("vec_id < 30").unionAll(df.where("vec_id < 30")).withColumn("vec_id", F.lit(None).cast("long")), 2)
    assert twice.count() == 120 and twice.where("vec_id IS NULL").count() == 120 and twice.first().n == 30


def test_flat_directions(spark):
    rng = random.Random(6)
    rows = [(i, [a, a, b, 3.0]) for i in range(50) for a, b in [(rng.gauss(0, 1), rng.gauss(0, 1))]]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 100 and got[0].identity_error < 1e-9 and abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-12


def test_lanczos():
    rng = np.random.default_rng(1)
    for values in ([*np.linspace(9, 1, 20), *[0.5] * 180], [4.0] * 10 + [1.0] * 90, [5.0, 3.0] + [0.0] * 98, [2.0] * 3):
        n = len(values)
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        a = (q * values) @ q.T
        e, v, passes = block_lanczos(lambda b, a=a: a @ b, n, 16)
        k = min(16, n)
        assert np.allclose(e, sorted(values)[::-1][:k], atol=1e-10) and np.allclose(v.T @ v, np.eye(k), atol=1e-10)
        assert np.abs(a @ v - v * e).max() < 1e-9 and passes <= -(-n // k)


def test_exact_deviations():
    rng = random.Random(2)
    for n, wide in ((3, 10), (10**6, 2000), (10**9, 1 << 40), (7, 1 << 46)):
        x = np.array([[rng.randrange(wide) for _ in range(4)] for _ in range(9)], np.int64)
        sums = [int(n * wide / 2) + i for i in range(4)]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
        assert deviations(x, Fit(n, sums, None, None, 0, 0)) == [w if w < 2**63 else None for w in want]
