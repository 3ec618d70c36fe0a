"""Every registered query against its SQL, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, duck
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(QUERIES))
def test_matches_sql(spark, con, key):
    ok, note = compare(spark, con, SF, key)
    assert ok, note


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["root_dir", "source_path", "size", "op_type", "dest_path"]
