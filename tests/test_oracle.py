"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF
from oracle import compare, connect

from typeloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None
