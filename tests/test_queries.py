"""Every core query of the entry against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from placeloom import queries as core

SF = "/root/testdata/sf0.001"


def rows(table):
    cols = sorted(table.column_names)
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return cols, sorted((tuple(map(norm, r)) for r in zip(*[table.column(c).to_pylist() for c in cols])), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    assert rows(entry.queries()[name](spark, SF).toArrow()) == rows(con.sql(core.oracle_sql()[name]).to_arrow_table())


def test_entry_is_complete():
    assert set(core.oracle_sql()) <= set(entry.queries())
