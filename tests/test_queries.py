"""Every registered query against its DuckDB twin, values and types."""

import os

import pytest

import __spark_entry__ as contract
from compare import differences, duck
from saleslens.plans.catalog import CATALOG
from saleslens.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(CATALOG) == set(ORACLE)
    assert set(CATALOG) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_its_twin(spark, con, name):
    mine = CATALOG[name](spark, SF_DIR).toArrow()
    theirs = con.sql(ORACLE[name]).to_arrow_table()
    assert mine.num_rows > 0
    assert differences(mine, theirs) == []


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert rows == sorted(rows, key=lambda row: row.month)
    assert rows
