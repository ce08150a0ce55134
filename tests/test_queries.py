"""Every query against its SQL on the smallest data; those without SQL must run and keep their schema."""

import pytest

from gridspark.plans import registry
from tests.util import rows, run_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        want = run_sql(SQL[name], sf_dir)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(5).count() == 5
