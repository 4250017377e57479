"""Every query of the core catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from cartolith.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(shown(row[c]) for c in columns) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
