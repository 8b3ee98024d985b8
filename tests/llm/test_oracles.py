import pytest
from compare import duck_rows, spark_rows

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    want, got = duck_rows(queries.ORACLES[name], sf), spark_rows(queries.QUERIES[name](spark, sf))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
