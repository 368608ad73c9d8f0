"""Every named query against its SQL twin on the smallest tables; queries without one must give rows."""

import pytest

from oracle_check import compare, connect
from tidewire import plans


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, con, sf_dir, name):
    ok, message = compare(spark, con, name, sf_dir)
    assert ok, message
