"""Every registered query against its SQL twin, on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from steplake.conformance import load_all

SF = os.environ.get("STEPLAKE_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    status, detail = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SF)
    assert status in ("exact", "rows-only"), detail
    assert " types " not in detail, detail


def test_coverage():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert not [n for n in QUERIES if re.search(r"pipeline|^op\d", n)]


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["o_orderpriority", "revenue", "n_orders"] and rows.count() == 5
