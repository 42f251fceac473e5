"""Every registered event-graph query against its SQL, on the smallest tables."""

import oracle
import pytest

from provgraph.plans import registry as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.difference(core.QUERIES[name](spark, SF), con, core.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_has_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
