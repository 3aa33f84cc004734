"""Every registered query gives what its SQL gives on the given tables."""

import os

import pytest
from check_oracle import compare

import __spark_entry__ as entry
from dumplake.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_over_dumps_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    same, _, _, detail = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert same, detail
