"""The registered queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace(" 00:00:00", "")
    return repr(round(float(v), 6)) if isinstance(v, int | float) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    left = sorted(str([value(r[c]) for c in names]) for r in got.collect())
    assert left == sorted(str([value(x) for x in r]) for r in want.fetchall())
