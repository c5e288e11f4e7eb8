"""Queries against their SQL where teams of the two pools have ids in common (3,000 suppliers and more)."""

from __future__ import annotations

import glob
import os

import pytest
from oracle import connection, difference

from boutlake.model import training as tr
from boutlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables with every other supplier's key raised by 3,000, less one where that would be its own pool's."""
    at, con = tmp_path_factory.mktemp("shared"), connection(SF)
    new = "({0} - {0} % 2 + 3000 * ({0} % 2))"
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        key = {"supplier": "s_suppkey", "lineitem": "l_suppkey"}.get(name)
        if key is None:
            os.symlink(path, at / f"{name}.parquet")
        else:
            con.execute(f"COPY (SELECT * REPLACE ({new.format(key)} AS {key}) FROM {name}) TO '{at}/{name}.parquet' (FORMAT parquet)")
    return str(at)


SAME = ["s7_submissions_by_season", "j22_dimension_merge", "j1_matchup_dataset_full", "a9_preseason_pick", "j11_j12_priors_to_sides", "j9_overlay", "m1_leave_one_season_out_all_seasons", "k5_keeps_input_order", "k5_keeps_input_order_all", "s16_filled_template", "s16_rejected_winners"]


@pytest.mark.parametrize("name", SAME)
def test_ids_of_two_pools_may_be_the_same(spark, tables, name):
    got = catalog.queries()[name](spark, tables).toPandas()
    assert difference(got, connection(tables).sql(catalog.oracle_sql()[name]).df()) == ""


def test_split_by_seed_does_not_depend_on_partitions(spark):
    ids = spark.range(2000).withColumnRenamed("id", "_seq")
    held = lambda df, seed: sorted(r[0] for r in df.where(tr.held_by_seed("_seq", seed)).collect())
    assert held(ids.repartition(7), 3) == held(ids.coalesce(1), 3) != held(ids, 4)
    assert 300 < len(held(ids, 3)) < 500
