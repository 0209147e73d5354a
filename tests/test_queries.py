"""Every registered query that has SQL against DuckDB, at the smallest size."""

import duckdb
import pytest

from tessera.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    res = duck.sql(ORACLE_SQL[name])
    assert sorted(res.columns) == names
    order = [res.columns.index(c) for c in names]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())
