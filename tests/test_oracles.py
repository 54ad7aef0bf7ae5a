"""Queries against the same in SQL, on the smallest tables."""

import duckdb
import pytest

import sparkwell.plans.more_queries
import sparkwell.plans.operator_queries  # noqa: F401  register their queries
from sparkwell.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([r[i] for i in at] for r in found.fetchall())
