"""Registered queries against their SQL at the smallest scale.

A quick selection by default; SKYTALLY_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

# sixteen regions need more pixels than the smallest scale has
SF = "/root/testdata/sf0.01" if os.environ.get("SKYTALLY_ALL") else "/root/testdata/sf0.001"
QUICK = ("x3_", "x4_", "x9_", "x16_", "a5_", "a10_", "a14_", "f4_", "f5_", "f9_full", "j7_", "m7_", "n2_", "p2_", "g6_", "g8_",
         "b3_", "t3_", "s6_", "w1_", "e7_", "n3_", "p3_fit")
NAMES = [n for n in entry.oracle_sql() if os.environ.get("SKYTALLY_ALL") or n.startswith(QUICK)]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_flagship_runs(spark, con):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(r.dd > 0 for r in rows)
