"""Every registered query against its SQL on a second engine."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
import check
from adcorpus.plans.catalog import QUERIES
from adcorpus.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = check.connect(SF_DIR)
    yield con
    con.close()


def test_contract():
    """Every query of the library has SQL; of the others, those that SQL can express."""
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "pos", "role", "content"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, duck, name):
    assert check.compare(spark, duck, name, SF_DIR) == ""


def test_the_comparison_sees_differences(spark, duck, monkeypatch):
    sql = contract.oracle_sql()
    for changed in (
        sql["parse_salary"].replace("p_partkey,", "p_partkey + 1 AS p_partkey,", 1),
        sql["parse_salary"] + " LIMIT 5",
        sql["parse_salary"].replace("AS predicted", "AS wrong"),
    ):
        monkeypatch.setattr(check, "oracle_sql", lambda: {"parse_salary": changed})
        assert check.compare(spark, duck, "parse_salary", SF_DIR)
