"""Operators that SQL can express, against DuckDB over the small tables."""

from pathlib import Path

import duckdb
import pytest

from framelake.llm import registry

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    df = registry.queries()[name](spark, str(DATA))
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall()) and sorted(df.columns) == sorted(names)
