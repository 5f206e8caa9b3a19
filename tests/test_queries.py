"""Every query gives its oracle's rows."""

import os

import duckdb
import pytest

from maskwright.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries that learn from the table and need more of it.
LARGER = {"people_found": "/root/testdata/sf0.01"}
TABLES = ("events", "documents", "benchmark", "orders", "nation", "part", "pages", "lineitem")


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, name):
    sf = LARGER.get(name, SF)
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).execute(registry.ORACLES[name]).df())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
