"""Every registered query against its DuckDB twin."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from haulbook.plans import oracles, registry

DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(oracles.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["state", "count"]
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in registry.queries() if not n.startswith("t0")])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in duck.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in duck.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want
    plain = (str, int, float, bool, type(None))
    assert not any(isinstance(v, (datetime.date, decimal.Decimal)) for r in got for v in r)
    assert all(isinstance(v, plain) for r in got for v in r)
