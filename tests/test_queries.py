"""Every query of the registry beside its SQL."""

from __future__ import annotations

import pytest

from pixelloom.plans import oracles
from pixelloom.plans import queries as plans
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(oracles.SQL) == set(plans.QUERIES)


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_sql(spark, name):
    assert assert_same(plans.QUERIES[name](spark, SF), oracles.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
