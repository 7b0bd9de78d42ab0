"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest

from pointgrain.plans import registry
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]))


def test_every_query_has_sql_or_a_property_test():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"c2st", "evaluate_classifier", "mixture_fit", "binomial_rates"}


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
