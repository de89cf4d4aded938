"""Every registered query of the reference operators against its SQL, at the smallest size."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import assert_same, connection

from cadenza.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        assert_same(got, con.execute(ORACLES[name]).df())
    else:
        assert list(got.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
