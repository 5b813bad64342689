"""Every contract query against its SQL statement on the smallest shared tables."""

import os
from pathlib import Path

import pytest

import oracle
from loudframe.contracts import ORACLES, QUERIES

SF_DIR = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="shared tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_contract(spark, con, name):
    assert oracle.compare(spark, con, name, SF_DIR) is None
