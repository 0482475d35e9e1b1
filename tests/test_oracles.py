"""Each query of the log engine against its SQL in DuckDB, over whole tables."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from logloom.plans import queries as log_queries

DATA = "/root/testdata/sf0.001"
ORACLES = log_queries.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_with_sql_exists():
    assert set(ORACLES) <= set(log_queries.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    found = log_queries.queries()[name](spark, DATA)
    wanted = db.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    rows = found.collect()
    assert rows and bag(found.columns, rows) == bag(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(log_queries.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert log_queries.queries()[name](spark, DATA).take(1)
