import pytest

import __spark_entry__ as entry
from tests.oracle import database, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with database(SF_DIR) as connection:
        yield connection


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 2 and rows[0]["samples"] > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
