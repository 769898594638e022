"""The queries whose contract SQL states, against DuckDB on the small tables."""

import duckdb
import pytest

from textloom.llm import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_contract(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entries.QUERIES[name](spark, sf)
    rel = con.sql(entries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    want = rel.select(*(f'"{c}"' for c in got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
