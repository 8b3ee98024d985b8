import os

import pytest
from compare import duck_rows, spark_rows

from millrace.plans import catalog

SF = os.environ.get("MILLRACE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    want = duck_rows(catalog.ORACLES[name], SF)
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
