"""Every catalogue query against its SQL on the smallest tables."""

import pytest
from compare import difference, oracle_connection

import __spark_entry__ as entry
from catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    frame = entry.queries()[name](spark, FOLDER)
    assert difference(frame, entry.oracle_sql()[name], connection) is None


def test_entry_has_rows_and_a_stable_schema(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang", "g"]
    assert frame.take(1)
