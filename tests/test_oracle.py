"""Every registered query against its SQL on the smallest tables."""

import pytest

from newsloom.catalog import REGISTRY, Tables
from tests.oracle import ROOT, connect, differences

SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(name, tables, con):
    assert differences(REGISTRY[name], tables, con) is None
