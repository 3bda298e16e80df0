"""Every query that has an oracle returns the oracle's rows, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from framelake.queries import ORACLES, QUERIES
from framelake.session import ship

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ship(spark)
    df = QUERIES[name](spark, str(DATA))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        assert got == rows_of([c[0] for c in result.description], result.fetchall())
    assert got[1], "no rows"
