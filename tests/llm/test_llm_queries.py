"""Every query of the operators: against its DuckDB twin where it has one."""

import os

import pytest

import __spark_entry__ as contract
from compare import differences, duck
from saleslens.llm.oracle import ORACLE
from saleslens.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_all_are_registered():
    names = set(contract.queries())
    assert set(QUERIES) <= names
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 14))
    assert "pipeline" in names
    assert set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_twin(spark, con, name):
    mine = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = con.sql(ORACLE[name]).to_arrow_table()
    assert mine.num_rows > 0
    assert differences(mine, theirs) == []
