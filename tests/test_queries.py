import pytest
from conftest import SF, rows

from tesserae.plans import registry

#: What SQL doesn't say; test_volumes.py holds these against brute force.
NO_SQL = {"assigned_links", "box_nms", "deconvolve", "minimum_threshold", "principal_axes", "watershed"}


def test_all_other_queries_have_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == NO_SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_sql_says(spark, duck, name):
    made = registry.queries()[name](spark, SF).toPandas()
    said = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(said.columns)
    assert rows(made) == rows(said)


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
