import os

import pytest

from tests.compare import compare, connect
from tidewater.plans import extended, forms  # noqa: F401
from tidewater.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_alike(spark, name):
    a, b = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b
