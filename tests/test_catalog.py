"""Every query with SQL is held against DuckDB on the small tables."""

import math
import os

import pytest

import jobs.queries  # noqa: F401
from pairloom.plans import catalog

#: Determinants of 10 x 10 matrices need more people than the smallest tables have.
LARGER, NEED_PEOPLE = "/root/testdata/sf0.01", ["five_tests", "oinfo", "perm_null_information", "pointwise_agreement", "pointwise_tc", "spline_residual_versions", "tc_k10"]
WITH_SQL = sorted(n for n, q in catalog.QUERIES.items() if q.sql and n not in NEED_PEOPLE)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.exists(LARGER), reason="needs the larger tables")
@pytest.mark.parametrize("name", NEED_PEOPLE)
def test_matrices_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{LARGER}/lineitem.parquet'")
    test_same_as_sql(spark, LARGER, con, name)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, sf_dir, duck, name):
    q = catalog.QUERIES[name]
    df = q.build(spark, sf_dir)
    want = duck.sql(q.sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert all(q.sql for q in catalog.QUERIES.values())
