"""Queries with an oracle give its rows."""

import duckdb
import pytest

from maskwright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    # pandas turns integers into floats where a column has nulls.
    plain = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    rows = lambda d: sorted(repr([*map(plain, r)]) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist())
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(queries.ORACLES[name]).df())
