"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from verification.compare import difference, oracle
from verification.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    text = ORACLES.get(name)
    if text is None:
        df.collect()
    else:
        assert difference(df, con, text) is None


def test_names():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) - len(ORACLES) == 3


def test_entry(spark):
    assert entry.entry(spark).count() == 5
