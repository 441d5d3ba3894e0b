"""Every query of the signal operators against its SQL, or at least run to its end."""

import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__._base()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, duck, same, name):
    same(QUERIES[name](spark, small).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    rows = QUERIES[name](spark, small)
    assert rows.columns and rows.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
