"""Every registered query with checking SQL agrees with it, row for row."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from lumenfield.plans import load_all
from tests.conftest import DATA
from tools.compare import TABLES, normal

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_inventory_is_covered():
    have = {i for q in load_all().values() for i in q.covers}
    sizes = {"S": 14, "P": 23, "J": 21, "A": 53, "W": 12, "L": 6, "U": 5, "F": 41, "T": 11, "X": 9}
    assert {f"{p}{i}" for p, n in sizes.items() for i in range(1, n + 1)} <= have
