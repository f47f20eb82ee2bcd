"""Rows that an order leaves open: queries take them as their SQL does."""

import duckdb
import pytest

from verso.plans.catalogue import ORACLE_SQL, QUERIES


def lineitem(folder, rows):
    """A lineitem table of (part, order, line, flag, status) with many rows of equal keys."""
    con = duckdb.connect()
    con.execute("create table t (l_partkey bigint, l_orderkey bigint, l_linenumber int, l_returnflag varchar, l_linestatus varchar)")
    con.execute(rows)
    con.execute(f"copy t to '{folder}/lineitem.parquet' (format parquet, row_group_size 20000)")


@pytest.mark.parametrize("rows", [
    "insert into t select i * 7919 % 3000, i % 10, 1 + i % 2, substr('ANR', 1 + (i // 7 % 3)::int, 1), substr('OF', 1 + (i // 11 % 2)::int, 1) from range(100000) r(i)",
    "insert into t values (1, 5, 1, 'A', 'O'), (1, 5, 1, 'R', 'F'), (2, 1, 1, NULL, 'O'), (2, 9, 1, 'N', 'O'), (3, NULL, 1, 'N', 'O'), (4, 2, 1, 'N', 'F'), (4, 2, 1, 'A', 'F')",
])
def test_first_rows_of_equal_keys(spark, tmp_path, rows):
    lineitem(tmp_path, rows)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    want = set(con.execute(ORACLE_SQL["io6_first_per_id"]).fetchall())
    assert {tuple(r) for r in QUERIES["io6_first_per_id"](spark, str(tmp_path)).collect()} == want
