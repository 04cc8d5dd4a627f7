"""Every registered query against its SQL twin on the smallest sample."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.check_queries import compare, connect

SAMPLE = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()
# Results that are rightly empty on this sample.
MAY_BE_EMPTY = {"influencer_bonus"}


@pytest.fixture(scope="module")
def duck():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SAMPLE)
    if name not in SQL:
        assert df.count() > 0
        return
    message = compare(df, duck, SQL[name])
    assert message is None or (message == "EMPTY" and name in MAY_BE_EMPTY), message


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "net_settlement_amount" in df.columns


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
