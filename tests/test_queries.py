"""Every registered query: against its SQL, or that it gives rows."""

import pytest

from tempofact import registry
from tests.compare import connect, same_rows

registry.load()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, db, name):
    same_rows(registry.QUERIES[name](spark, FOLDER), db, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.columns and df.collect() is not None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
