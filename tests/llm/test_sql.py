import pytest

from tests import oracle
from weft.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.differs(spark, oracle.connection(sf_dir), sf_dir, Q.queries()[name], Q.oracle_sql()[name]) == ""
