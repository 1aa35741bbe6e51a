"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.check_oracles import connect, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, db, name):
    frame = contract.queries()[name](spark, SF_DIR).toPandas()
    assert len(frame) > 0
    assert differences(frame, db.sql(contract.oracle_sql()[name]).df()) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
