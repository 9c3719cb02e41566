"""Every registered query runs, and equals its DuckDB text, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    build = entry.queries()[name]
    if name in ORACLES:
        assert oracle.compare(spark, con, SF_DIR, name, build, ORACLES[name]) is None
    else:
        assert build(spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
