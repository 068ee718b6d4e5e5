"""Registered queries against their SQL, on the smallest tables.

The queries that run whole ingests are covered in test_ingest and test_streaming.
"""

import math

import duckdb
import pytest

from oracle_queries import statements
from registered_queries import registered

SMALL = "/root/testdata/sf0.001"
TABLES = ["events", "lineitem", "documents"]
QUICK = [
    name for name in registered() if not name.startswith(("ingest", "stream", "changed"))
]


def test_every_query_has_its_sql():
    assert registered().keys() == statements().keys()


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')"
            )
        yield connection


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 9)
        return value

    return sorted((tuple(plain(row[at]) for at in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df = registered()[name](spark, SMALL)
    result = duck.execute(statements()[name])
    names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, map(tuple, df.collect())) == comparable(names, result.fetchall())
