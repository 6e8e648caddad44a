"""Every query with SQL gives what DuckDB finds by that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stemma.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    put = lambda v: "∅" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(put(row[k]) for k in order) for row in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    wanted = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert cells(got.columns, got.collect()) == cells(wanted.columns, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
