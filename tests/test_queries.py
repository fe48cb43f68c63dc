"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from episodica.plans import catalog
from tests.compare import duck, rows


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, con, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
