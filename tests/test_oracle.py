"""Every registered query against its DuckDB oracle (row count, column names
and kinds, order-insensitive value hash) on the small corpus."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF001  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402
from quillspark.plans import all_oracles, all_queries  # noqa: E402

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_oracle(spark, con, key):
    r = compare(spark, con, key, QUERIES[key], ORACLES[key], SF001)
    assert r["cols_match"] and r["types_match"] and r["hash_match"], r


def test_every_query_has_oracle_or_serial_test():
    assert set(QUERIES) - set(ORACLES) == {"gen_v2_dedup"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "primary_intent" in df.columns
