import oracle
import pytest

from riskspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert oracle.actual(queries.QUERIES[name](spark, SF)) == oracle.expected(queries.ORACLE_SQL[name], SF)
