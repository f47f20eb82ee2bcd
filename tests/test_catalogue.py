"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from verso.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLE_SQL:
        return
    found = db.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    want = sorted([plain(v) for _, v in sorted(zip(found.columns, r, strict=True))] for r in found.fetchall())
    got = sorted([plain(v) for _, v in sorted(zip(df.columns, r, strict=True))] for r in rows)
    assert got == want
