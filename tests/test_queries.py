import pytest

import __spark_entry__ as entry
from tests import oracle
from weft import queries as Q


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert oracle.differs(spark, con, sf_dir, Q.queries()[name], Q.SQL[name]) == ""


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(Q.SQL) <= set(names)


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j", "dist"] and entry.entry(spark).count() > 0
