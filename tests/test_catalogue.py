"""Every named query against its SQL on the smallest given tables."""

import pytest

from tarmac.catalogue.all import QUERIES
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    query = QUERIES[name]
    df = query.build(spark, SF_DIR)
    if query.sql is None:
        assert df.count() > 0
        return
    assert compare(df, con, query.sql) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == [
        "cell_id", "grid_lat", "grid_lon", "collisions", "casualties", "risk_score", "distance_miles",
    ]
    assert set(entry.oracle_sql()) <= set(entry.queries())
