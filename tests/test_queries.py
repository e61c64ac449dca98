"""Every query of the library against its SQL in DuckDB."""

import pytest
from compare import connect, oracle_rows, rows_of

from tracemill import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    assert rows_of(core.queries()[name](spark, sf_dir)) == oracle_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r.log_level for r in entry.entry(spark).collect()} == {"ERROR", "WARNING", "INFO"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
