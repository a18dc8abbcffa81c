"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con, sf_dir):
    ok, n, _, note = compare(name, spark, con, sf_dir, QUERIES, ORACLES)
    assert ok is not False, note
    assert n > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
