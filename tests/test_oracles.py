"""Every query against its SQL, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, duck
from verdictflow.catalog import QUERIES
from verdictflow.oracle import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(DATA)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, DATA, QUERIES[name], ORACLES[name], db) is None


def test_entry(spark):
    assert entry(spark).count() > 0
