"""Every registered query against its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(res.columns, res.fetchall())


def test_entry_runs(spark):
    assert E.entry(spark).count() >= 0


def test_absent_operators_are_left_out(monkeypatch):
    import sys
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "posts" in E.queries() and "pipeline" not in E.queries()
    assert not any(n.startswith("op1") for n in (*E.queries(), *E.oracle_sql()))
