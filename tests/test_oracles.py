"""Every registered query against its SQL twin on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        problems, _ = compare(spark, con, SF, QUERIES[name], ORACLES[name])
        assert not problems, problems
    else:
        assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 34 and df.limit(1).count() == 1
