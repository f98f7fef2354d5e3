import pytest

from tabweave.plans import registry

from .compare import assert_same, database
from .conftest import SF


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.SQL[name], db)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
