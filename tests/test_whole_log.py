"""Queries about the whole log leave no season of it out."""

from __future__ import annotations

from boutlake.plans import catalog, catalog_model
from boutlake.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def seasons(df):
    return sorted(r[0] for r in df.select("Season").distinct().collect())


def test_models_see_all_seasons(spark):
    g = fx.game_raw(spark, SF)
    want = g.count()
    x = catalog_model.reg_games(spark, SF)
    assert seasons(x) == seasons(g) and x.count() == 2 * want


def test_every_season_is_a_fold(spark):
    g = fx.game_raw(spark, SF)
    assert seasons(catalog_model.regular_log(spark, SF)) == seasons(g)
    pivot = catalog.queries()["a37_fold_pivot_all_seasons"](spark, SF)
    assert pivot.columns == ["men_women", *[f"s{y}" for y in seasons(g)]]
