"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lattica.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(r[i] for i in at) for r in found.fetchall()) == sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
