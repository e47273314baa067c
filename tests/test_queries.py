"""Every registered query with SQL gives the rows of that SQL."""

import pytest
from compare import difference

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, folder, duck):
    assert difference(entry.queries()[name](spark, folder), duck, SQL[name]) is None


def test_sql_has_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_inlined_stop_words_are_sparks(spark):
    from caseloom.functions.text import default_stop_words
    from caseloom.plans.oracle import STOP_WORDS

    assert STOP_WORDS == default_stop_words()
