"""Registered queries next to their comparison SQL on the smallest generated tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import check, connect
from checks.oracle import all_sql
from checks.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no generated tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_comparison_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "tipo_usuario" and df.count() == 3


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    assert check(spark, con, name, SF_DIR) == ""
