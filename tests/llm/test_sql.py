"""The operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from evidentia.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert len(got) and columns == sorted(want.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)
