import pytest

from lexora.plans import catalogue
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == duck_rows(catalogue.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).limit(5).count() > 0
