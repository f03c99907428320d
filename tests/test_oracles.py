"""Every registered query against its SQL twin, at the smallest scale."""

import pytest

from geopulse.queries import ORACLES, QUERIES
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLES
    note = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    # Some filters keep nothing at this scale.
    assert note in ("", "no rows")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
