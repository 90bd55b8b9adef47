"""The entry module: every query runs on the smallest tables and agrees with its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows

SMALL = "/root/testdata/sf0.001"
#: One query of each family; verify.py runs all of them.
SOME = ["p1_found", "p6_found", "h5_headers", "agg4_cross_documents", "j5_table_diff", "agg7_rules", "j11_evidence", "k1_lookup", "s1_index_merge", "st2_sessions", "agg11_totals"]


@pytest.fixture(scope="module")
def oracle():
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, oracle, name):
    mine, theirs = entry.queries()[name](spark, SMALL).toPandas(), oracle.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and rows(mine) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, oracle):
    assert entry.entry(spark).count() > 0
