"""Every query with an oracle equals it on the small generated tables."""

import os

import duckdb
import pytest

import __spark_entry__
from stemma import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    want = oracle.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(tuple(r) for r in frame.select(*columns).collect()) == rows(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
