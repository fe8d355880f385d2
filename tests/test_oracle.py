"""Every registered query beside its SQL in DuckDB, over whole tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    rel = duck.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert compare(df.columns, rows, columns, rel.fetchall()) == "ok"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.n for r in rows) == 6000 and len(rows) == 2
