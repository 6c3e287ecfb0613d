from __future__ import annotations

import os

import pytest

from tessera.plans import registry
from tests.oracle import compare, connect

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None
