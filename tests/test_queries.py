"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from tallyloom import plans

plans.load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    good, text = compare(spark, duck, plans.QUERIES[name], plans.ORACLE_SQL[name], sf_dir)
    assert good, text


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_without_sql_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["step", "value"]
