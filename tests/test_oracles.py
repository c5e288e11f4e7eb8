"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connection, difference

from boutlake.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"a5_fixed_point", "m1_leave_one_season_out", "m17_ablation", "m9_field_pair_predictions", "r4_snapshot_refresh_converged"}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        assert difference(got, con.sql(sql).df()) == ""


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 10
