import duckdb
import pytest

from sievework.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    ran = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in ran.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(ran.fetchall()) == sorted(tuple(r) for r in df.select(*columns).collect())
