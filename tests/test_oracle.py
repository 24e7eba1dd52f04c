"""Every query with SQL has the same rows as its SQL."""

import pytest

from driftline import catalog
from tests.compare import database, differences, spark_rows, sql_rows


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    assert differences(spark_rows(catalog.QUERIES[name](spark, sf)), sql_rows(db, catalog.ORACLE_SQL[name])) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
