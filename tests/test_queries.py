"""The registered queries against their SQL on the smallest tables. ``compare.py`` runs them on larger ones."""

import os

import __spark_entry__ as entry
import pytest
from compare import difference, sql_engine

from starcast.checks import views

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKED = list(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    return sql_engine(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, engine, name):
    assert difference(spark, engine, name, SF_DIR) is None


def test_entry(spark):
    result = entry.entry(spark)
    scored = views.pairs(spark, "/root/testdata/sf0.001").count()
    assert result.columns == ["user_id", "business_id", "prediction"] and result.count() == scored > 1_000
