"""Every catalogue query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lattica.plans import catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.item() if hasattr(value, "item") else value


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr) == rows
