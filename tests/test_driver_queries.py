import datetime
import os

import duckdb
import pytest

from sievework.plans import alert_queries, audit_queries, driver_queries, paging_queries, posting_queries  # noqa: F401  each registers its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(posting_queries.oracle_table()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = driver_queries.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    ran = duck.execute(driver_queries.ORACLES[name])
    columns = [d[0] for d in ran.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, ran.fetchall())
    assert want and rows_of(df.columns, got) == want
