"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import emberline.plans.flows  # noqa: F401
import emberline.plans.hooks  # noqa: F401
import emberline.plans.records  # noqa: F401
import emberline.plans.reports  # noqa: F401
import emberline.plans.retrieval  # noqa: F401
import emberline.plans.rules  # noqa: F401
import emberline.plans.store  # noqa: F401
import emberline.plans.texts  # noqa: F401
from emberline.plans.catalog import CASES, CASES_SQL, QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL | CASES_SQL))
def test_query_equals_sql(spark, duck, name):
    df = (QUERIES | CASES)[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = duck.sql((SQL | CASES_SQL)[name])
    assert sorted(sql.columns) == columns
    at = [list(sql.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cases_are_no_queries():
    assert CASES and not set(CASES) & set(QUERIES) and set(CASES_SQL) == set(CASES)
