"""The registered queries with SQL give DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from pageframe.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    if not SF.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(wanted, key=repr)
