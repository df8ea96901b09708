"""Queries against their DuckDB SQL."""

import duckdb
import pytest

from stratalens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert len(got) == 1000
    assert got == sorted(repr(tuple(r)) for r in duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
