import pytest


import oracle
from riskspark import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    columns, rows = oracle.actual(queries.QUERIES[name](spark, SF))
    if name in queries.ORACLE_SQL:
        assert (columns, rows) == oracle.expected(queries.ORACLE_SQL[name], SF)
    else:
        assert rows
