"""Every query against its DuckDB twin on the smallest tables."""

import pytest

from tidemark import catalogue

from compare import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(name, spark, sf, duck):
    same(catalogue.QUERIES[name](spark, sf), duck.sql(catalogue.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_models(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
