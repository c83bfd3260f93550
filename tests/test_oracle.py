"""Every query that SQL can state gives the same rows on both engines."""

import pytest

from quern.plans import load_all
from quern.session import RUNTIME_CONF
from tests.oracle import connect, difference, duck_rows, spark_rows

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLE))
def test_same_rows(spark, con, sf_dir, name):
    got = spark_rows(REGISTRY.QUERIES[name](spark, sf_dir))
    assert difference(got, duck_rows(con, REGISTRY.ORACLE[name])) is None


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLE)))
def test_rows_only(spark, sf_dir, name):
    assert REGISTRY.QUERIES[name](spark, sf_dir).count() > 0


def test_prepare_sets_only_what_may_change(spark):
    assert all(spark.conf.isModifiable(key) for key in RUNTIME_CONF)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["day", "order_count", "total_sales"]
