"""Every query with an SQL twin gives the same rows as DuckDB."""

import pytest

from tests.compare import difference, duck
from verbatim.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_rows(name, spark, sf, con):
    got = catalog.queries()[name](spark, sf).toPandas()
    assert difference(got, con.execute(catalog.oracle_sql()[name]).df()) is None


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["word", "source", "n"]
    assert entry.queries().keys() >= entry.oracle_sql().keys()
