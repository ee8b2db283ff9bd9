"""Every registered core query against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from sparkseek.plans.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())
    assert sorted(names) == columns
    assert got == want
