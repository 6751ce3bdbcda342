"""Every registered query that has SQL gives the same rows as that SQL; the others give rows."""

import pytest

import __spark_entry__ as entry_module
from compare import connect, difference, schema_difference

from starlens.plans.oracle import build  # noqa: E402
from starlens.plans.queries import QUERIES  # noqa: E402

SQL = build()
SLOW = {"ml_logreg_report"}  # its two halves are tested as ml_logreg and classification_report


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_all_of_the_library_is_registered():
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert schema_difference(df, con, SQL[name]) is None
    assert difference(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1
