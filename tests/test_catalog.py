"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalog, oracles


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_query_gives_what_sql_gives(spark, sf_dir, duck, same, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    same(got, duck.sql(oracles.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).limit(1).collect()


def test_entry_is_registered(spark):
    assert entry.entry(spark).columns == ["query_id", "recall"]
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
