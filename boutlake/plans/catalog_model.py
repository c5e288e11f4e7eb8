"""Queries on models (M rows and A32): structure and floors are checked, never published accuracies."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from boutlake.functions import scores
from boutlake.model import tournament
from boutlake.model import training as tr
from boutlake.operators import history, metrics, symmetric
from boutlake.plans import fixtures as fx
from boutlake.plans.catalog_joins import matchups
from boutlake.plans.catalog_log import rolling_ab, seed_numbers
from boutlake.plans.registry import query
from boutlake.tables import pinned

SMALL = tr.Settings(trees=4, depth=3, step=0.3)
FEATURES = ["d_NetEff", "d_Elo", "A_home", "s_Tempo"]


def reg_games(spark, d):
    """Point-in-time games of all seasons from both sides with Elo, season-to-date rates and venue. The games are written once for the three."""
    with fx.games_once(spark, d):
        g = fx.game_raw(spark, d)
        elo = history.pregame_elo(g, k=60.0, carry=0.9).select("_seq", "W_Elo_pre", "L_Elo_pre")
        r = rolling_ab(spark, d).drop("men_women", "Season")
    x = g.join(elo, "_seq").join(r, "_seq")
    diff, total = F.col("WScore") - F.col("LScore"), F.col("WScore") + F.col("LScore")

    def side(a_won: bool):
        s = 1 if a_won else -1
        a, b = ("W", "L") if a_won else ("L", "W")
        return F.struct(F.col(f"{a}TeamID").alias("A_TeamID"), F.col(f"{b}TeamID").alias("B_TeamID"), (s * diff).alias("Margin"), total.alias("Total"), F.lit(int(a_won)).alias("Outcome"), scores.home_sign(F.col("WLoc"), a_won).cast("double").alias("A_home"), (s * (F.col("W_Elo_pre") - F.col("L_Elo_pre"))).alias("d_Elo"), (s * (F.col("A_NetEff") - F.col("B_NetEff"))).alias("d_NetEff"), (F.col("A_Tempo") + F.col("B_Tempo")).alias("s_Tempo"))

    return x.select("_seq", "Season", "men_women", "DayNum", F.explode(F.array(side(True), side(False))).alias("r")).select("_seq", "Season", "men_women", "DayNum", "r.*")


def check(df, bad):
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).cast("int").alias("n_violations"))


def tournament_folds(spark, d):
    """Out-of-fold tournament probabilities ``p`` of all seasons, scaled by segment temperature."""
    m = pinned(matchups(spark, d, pools=True).withColumns({"Margin": F.col("PointDiff"), "DayNum": F.lit(134)}))
    oof = pinned(tr.leave_one_out(m, ["d_AdjEM", "d_Seed", "d_avg_Score"], SMALL))
    t = metrics.fit_grid(oof.select("men_women", "pred_prob", "Outcome"), ["men_women"], lambda t: (scores.temper(F.col("pred_prob"), t) - F.col("Outcome")) ** 2, 0.5, 5.0, "t", points=7, rounds=2)
    temp = F.lit(1.0)
    for (pool,), v in t.items():
        temp = F.when(F.col("men_women") == pool, F.lit(v)).otherwise(temp)
    return oof.withColumn("p", scores.temper(F.col("pred_prob"), temp))


def improper(p):
    return p.isNull() | (p <= 0) | (p >= 1)


@query("m1_leave_one_season_out", "game_raw", "SELECT 2 * count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE DayNum >= 134 AND Season >= 1999")
def _(spark, d):
    """Tournament folds of all seasons: every row has a probability within (0, 1). The SQL reports 1999 on."""
    return check(tournament_folds(spark, d).where("Season >= 1999"), improper(F.col("p")))


@query("m1_leave_one_season_out_all_seasons", "game_raw", "SELECT 2 * count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE DayNum >= 134")
def _(spark, d):
    """The same folds, all of them reported."""
    return check(tournament_folds(spark, d), improper(F.col("p")))


@query("m2_m3_m4_production", "game_raw", "SELECT 2 * count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE Season = 2001")
def _(spark, d):
    """Fitted on earlier seasons, scored on the last: probabilities in (0, 1), scores add up to total and margin."""
    g = pinned(reg_games(spark, d), ["Season"])
    model = tr.train(g.where("Season < 2001"), FEATURES, SMALL, written=True)
    s = model.scores(g.where("Season = 2001"))
    bad = ~F.col("pred_prob").between(0, 1) | (F.abs(F.col("pred_a") + F.col("pred_b") - F.col("pred_total")) > 1e-9) | (F.abs(F.col("pred_a") - F.col("pred_b") - F.col("pred_margin")) > 1e-9)
    return check(s, bad)


def regular_log(spark, d):
    """Out-of-fold frame of all seasons without the holdout season, the holdout scored apart, one log."""
    g = pinned(reg_games(spark, d), ["Season"])
    oof = tr.leave_one_out(g, FEATURES, SMALL, holdout=[2001], written=True)
    held = tr.train(g.where("Season < 2001"), FEATURES, SMALL, written=True).transform(g.where("Season = 2001"))
    return tr.predictions_log(oof, held)


@query("m5_m6_regular_log", "game_raw", "SELECT CASE WHEN Season < 2001 THEN 'oof' ELSE 'holdout' END AS source, 2 * count(*) AS n FROM game_raw WHERE Season >= 1999 GROUP BY 1")
def _(spark, d):
    """The log's rows by source. The SQL reports 1999 on."""
    return regular_log(spark, d).where("Season >= 1999").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("m5_m6_regular_log_all_seasons", "game_raw", "SELECT CASE WHEN Season < 2001 THEN 'oof' ELSE 'holdout' END AS source, 2 * count(*) AS n FROM game_raw GROUP BY 1")
def _(spark, d):
    """The whole log's rows by source."""
    return regular_log(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("m7_margin_calibrator", "plog", "SELECT 1 AS monotone, 1 AS normal_equations FROM (SELECT count(*) FROM plog)")
def _(spark, d):
    """Probability rises with margin; at the optimum the mean probability is the mean outcome."""
    p = fx.plog(spark, d).withColumn("noisy", F.col("Margin") + F.col("_seq") % 41 - 20)
    c = tr.fit_calibrator(p, SMALL, "noisy")
    s = tr.probability(p, c, "noisy", "q").agg(F.abs(F.avg("q") - F.avg("Outcome")).alias("gap"))
    return s.select(F.lit(int(float(c.coefficients[0]) > 0)).alias("monotone"), (F.col("gap") < 1e-3).cast("int").alias("normal_equations"))


@query("m8_ensemble", "plog matched", "SELECT coalesce(a._seq, b._seq) AS _seq, CASE WHEN a._seq IS NULL THEN cmp_prob WHEN b._seq IS NULL THEN pred_prob ELSE 0.6 * pred_prob + 0.4 * cmp_prob END AS pred_prob, 0.9 * CASE WHEN a._seq IS NULL THEN cmp_margin WHEN b._seq IS NULL THEN pred_margin ELSE 0.6 * pred_margin + 0.4 * cmp_margin END AS pred_margin FROM (SELECT _seq, pred_prob, pred_margin FROM plog WHERE _seq % 7 <> 0) a FULL JOIN (SELECT _seq, cmp_prob, cmp_margin FROM matched) b ON a._seq = b._seq", "pred_prob pred_margin")
def _(spark, d):
    from boutlake.plans.catalog_joins import matched

    b = matched(spark, d).select("_seq", F.col("cmp_prob").alias("pred_prob"), F.col("cmp_margin").alias("pred_margin"))
    return tr.ensemble(fx.plog(spark, d).where("_seq % 7 <> 0"), b, ["_seq"])


@query("m10_upcoming_games", "game_raw", "SELECT count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE Season = 2001 AND DayNum BETWEEN 100 AND 110")
def _(spark, d):
    """A slate of fixtures scored in one batch: spread, total, probability and moneylines of opposite sign."""
    g = pinned(reg_games(spark, d), ["Season"])
    model = tr.train(g.where("Season < 2001"), FEATURES, SMALL, written=True)
    s = model.scores(g.where("Season = 2001 AND DayNum BETWEEN 100 AND 110 AND Outcome = 1"))
    a, b = scores.moneyline_of(F.col("pred_prob")), scores.moneyline_of(1 - F.col("pred_prob"))
    return check(s.withColumns({"a": a, "b": b}), F.col("a").isNull() | (F.col("a") * F.col("b") > 0) & (F.abs(F.col("pred_prob") - 0.5) > 1e-9))


def drivers_add_up(spark, d, rows: str):
    """The log is written once, the forest fitted on its cells; the prediction goes through the attribution beside the row, so nothing is joined."""
    g = pinned(reg_games(spark, d).select("_seq", "Season", "DayNum", "Outcome", "Margin", *FEATURES), ["Season"])
    m = tr.fit_whole(g.where("Season < 2001"), FEATURES, SMALL)
    own = m.transform(g.where(rows).withColumn("row", F.col("_seq") * 2 + F.col("Outcome")))
    told = tr.path_attribution(m, own, FEATURES, "row", top=4, keep=("pred_margin",))
    return check(told, F.abs(F.col("explained") - F.col("pred_margin")) > 1e-6)


@query("m11_top_drivers", "game_raw", "SELECT 2 * count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE Season = 2001 AND DayNum < 60")
def _(spark, d):
    """Base and contributions of the tree paths add up to the prediction."""
    return drivers_add_up(spark, d, "Season = 2001 AND DayNum < 60")


@query("m11_top_drivers_all", "game_raw", "SELECT 2 * count(*) AS n_rows, 0 AS n_violations FROM game_raw")
def _(spark, d):
    """Every row of the log told."""
    return drivers_add_up(spark, d, "true")


@query("m12_leaf_calibration", "game_raw", "SELECT 2 * count(*) AS n_rows, 0 AS n_violations FROM game_raw WHERE Season = 2001")
def _(spark, d):
    """The older variant: leaf indices of the forest, one-hot with inverse document frequency, into a logistic model."""
    g = pinned(reg_games(spark, d))  # four fits and the scoring read it
    x = tr.assembled(g, FEATURES)
    m = GBTRegressor(featuresCol="x", labelCol="Margin", maxIter=4, maxDepth=3, seed=7, leafCol="leaf").fit(x.where("Season < 2001"))
    words = F.transform(vector_to_array("leaf"), lambda v, i: F.concat_ws("_", i.cast("string"), v.cast("int").cast("string")))
    leaves = m.transform(x).withColumn("words", words).drop("x", "prediction")
    fit = leaves.where("Season < 2001")
    cv = CountVectorizer(inputCol="words", outputCol="tf", vocabSize=4096).fit(fit)
    idf = IDF(inputCol="tf", outputCol="z").fit(cv.transform(fit))
    lr = LogisticRegression(featuresCol="z", labelCol="Outcome", regParam=0.01, maxIter=30).fit(idf.transform(cv.transform(fit)))
    p = lr.transform(idf.transform(cv.transform(leaves.where("Season = 2001")))).withColumn("p", vector_to_array("probability")[1])
    return check(p, ~F.col("p").between(0, 1))


@query("m13_m14_fold_ensemble", "game_raw", "SELECT 4 AS n_features, 1 AS sums_to_one, 2 * count(*) AS n_rows FROM game_raw WHERE Season = 2001")
def _(spark, d):
    """Mean spread over fold models, and their mean importances."""
    g = pinned(reg_games(spark, d), ["Season"])
    models = tr.fold_models(g.where("Season < 2001"), FEATURES, SMALL, written=True)
    own = g.where("Season = 2001")
    for i, m in enumerate(models):
        own = m.transform(own).withColumnRenamed("pred_margin", f"m{i}")
    n = own.select((sum(F.col(f"m{i}") for i in range(len(models))) / len(models)).alias("spread")).agg(F.count("spread").alias("n_rows"))
    imp = tr.importances(models, FEATURES, spark).agg(F.count(F.lit(1)).cast("int").alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-6).cast("int").alias("sums_to_one"))
    return imp.crossJoin(n)  # one row each


@query("m15_quick_model", "plog", "SELECT 1 AS deterministic, 1 AS bounded FROM (SELECT count(*) FROM plog)")
def _(spark, d):
    """Random split by seed, a logistic model and its held-out Brier score: the same seed gives the same of all three. Held-out probabilities and scores are within 0 and 1."""
    p = pinned(fx.plog(spark, d).select("_seq", "pred_margin", "pred_total", "Outcome"))  # both rounds read it
    vector, chance = VectorAssembler(inputCols=["pred_margin", "pred_total"], outputCol="x"), vector_to_array("probability")[1]

    def quick(seed):
        fit, held = map(vector.transform, tr.split_by_seed(p, "_seq", seed))
        m = LogisticRegression(featuresCol="x", labelCol="Outcome", regParam=0.01, maxIter=20).fit(fit)
        told = m.transform(held).agg(F.count(F.lit(1)), F.avg((chance - F.col("Outcome")) ** 2), F.min(chance), F.max(chance)).first()
        return [*m.coefficients, m.intercept, *told]

    a, b = quick(3), quick(3)
    same = all(x == y or abs(x - y) < 1e-6 for x, y in zip(a, b))
    bounded = not a[3] or all(0 <= x <= 1 for x in a[4:])  # without a held-out row there is nothing to bound
    return p.agg(F.lit(int(same)).alias("deterministic"), F.lit(int(bounded)).alias("bounded"))


def baseline(spark, d):
    return tr.leave_one_out(reg_games(spark, d), ["d_Elo", "A_home"], SMALL)


def against_naive(oof):
    mean = F.avg(F.abs(F.col("Total") - F.col("pred_total")))
    return oof.agg(F.count(F.lit(1)).alias("n_rows"), (mean < 2 * F.stddev_pop("Total")).cast("int").alias("better_than_naive"))


@query("m16_baseline", "game_raw", "SELECT 2 * count(*) AS n_rows, 1 AS better_than_naive FROM game_raw WHERE Season >= 1999")
def _(spark, d):
    """Two heads on few features, out of fold over all seasons; the total head is no worse than twice the naive one. The SQL reports 1999 on."""
    return against_naive(baseline(spark, d).where("Season >= 1999"))


@query("m16_baseline_all_seasons", "game_raw", "SELECT 2 * count(*) AS n_rows, 1 AS better_than_naive FROM game_raw")
def _(spark, d):
    """The same, all seasons reported."""
    return against_naive(baseline(spark, d))


def ablation(spark, d, reported: str):
    """Rows predicted by the same folds, all seasons, with and without a column group."""
    g = pinned(reg_games(spark, d), ["Season"])  # both variants read it
    parts = []
    for label, features in (("with", FEATURES), ("without", [f for f in FEATURES if f != "d_NetEff"])):
        oof = tr.leave_one_out(g, features, SMALL, written=True).where(reported)
        parts.append(oof.agg(F.count("pred_prob").alias("n")).select(F.lit(label).alias("variant"), "n"))
    return parts[0].unionByName(parts[1])


@query("m17_ablation", "game_raw", "SELECT unnest(['with', 'without']) AS variant, 2 * (SELECT count(*) FROM game_raw WHERE Season >= 1999) AS n")
def _(spark, d):
    """The same folds with and without a column group. The SQL reports 1999 on."""
    return ablation(spark, d, "Season >= 1999")


@query("m17_ablation_all_seasons", "game_raw", "SELECT unnest(['with', 'without']) AS variant, 2 * (SELECT count(*) FROM game_raw) AS n")
def _(spark, d):
    """The same, all seasons reported."""
    return ablation(spark, d, "true")


@query("m18_frozen_tournament", "game_raw", "SELECT CASE WHEN round_num = 1 THEN 'first' ELSE 'later' END AS part, count(*) AS n FROM (SELECT dense_rank() OVER (PARTITION BY men_women ORDER BY DayNum) AS round_num FROM game_raw WHERE Season = 2001 AND DayNum >= 134) GROUP BY 1")
def _(spark, d):
    """A season's tournament with features frozen before it, reported by round."""
    g = pinned(reg_games(spark, d), ["Season"])
    model = tr.train(g.where("Season < 2001 OR DayNum < 134"), FEATURES, SMALL, written=True)
    last = Window.partitionBy("men_women", "A_TeamID").orderBy(F.desc("DayNum"), F.desc("_seq"))
    frozen = g.where("Season = 2001 AND DayNum < 134").withColumn("n", F.row_number().over(last)).where("n = 1").select("men_women", F.col("A_TeamID"), *[F.col(c).alias(f"f_{c}") for c in ("d_Elo", "d_NetEff", "s_Tempo")])
    t = g.where("Season = 2001 AND DayNum >= 134 AND Outcome = 1").join(frozen, ["men_women", "A_TeamID"], "left")
    t = t.withColumns({c: F.col(f"f_{c}") for c in ("d_Elo", "d_NetEff", "s_Tempo")})
    s = history.with_round_numbers(model.transform(t), ["men_women"])
    return s.groupBy(F.when(F.col("round_num") == 1, "first").otherwise("later").alias("part")).agg(F.count("pred_prob").alias("n"))


@query("a32_home_edge", "game_raw", "SELECT 2 * count(*) AS n_rows, 1 AS finite FROM game_raw WHERE Season = 2001")
def _(spark, d):
    """Partial dependence on the venue: two counterfactual copies scored, the mean difference."""
    g = pinned(reg_games(spark, d), ["Season"])
    model = tr.train(g.where("Season < 2001"), FEATURES, SMALL, written=True)
    own = g.where("Season = 2001").drop("A_home")
    m = [model.transform(own.withColumn("A_home", F.lit(v))).agg(F.avg("pred_margin").alias(f"m{i}"), F.count(F.lit(1)).alias(f"n{i}")) for i, v in enumerate((1.0, -1.0))]
    return m[0].crossJoin(m[1]).select(F.col("n0").alias("n_rows"), F.coalesce(F.abs(F.col("m0") - F.col("m1")) < 100, F.lit(False)).cast("int").alias("finite"))  # one row each


@query("m9_field_pair_predictions", "seeds", "SELECT count(*) AS n_rows, 0 AS n_violations FROM seeds a JOIN seeds b ON a.Season = b.Season AND a.men_women = b.men_women AND a.TeamID < b.TeamID WHERE a.r <= 16 AND b.r <= 16 AND a.Season = 2001")
def _(spark, d):
    """All pairs of a field through the same feature path as training: swapping sides mirrors the features."""
    from boutlake.operators import match
    from boutlake.plans.catalog_joins import field, team_features

    feats = ["AdjEM", "avg_Score", "eFGpct"]
    tf = team_features(spark, d, pools=True)
    m = pinned(matchups(spark, d, pools=True).where("Season < 2001").withColumns({"Margin": F.col("PointDiff"), "DayNum": F.lit(134)}))
    model = tr.train(m, [f"d_{c}" for c in feats], SMALL)
    pairs = match.field_pairs(field(spark, d, 16).where("Season = 2001"))
    x = symmetric.fan_out(symmetric.attach_both(pairs, tf, ["men_women", "Season"], feats), feats)
    return check(model.transform(x), ~F.col("pred_prob").between(0, 1))


# --- models whose predictions SQL can compute: with the venue as only feature, a forest's leaves are means by venue

EXACT = tr.Settings(trees=2, depth=3, step=1.0, subsample=1.0)
_sign = "CASE WLoc WHEN 'H' THEN 1 WHEN 'A' THEN -1 ELSE 0 END"
fx.SQL["sided"] = f"SELECT _seq, Season, 1 AS Outcome, {_sign} AS A_home, WScore - LScore AS Margin, WScore + LScore AS Total FROM game_raw UNION ALL SELECT _seq, Season, 0, -{_sign}, LScore - WScore, WScore + LScore FROM game_raw"
fx.SQL["venues"] = "SELECT Season, A_home, count(*) AS n, sum(Margin) AS m, sum(Total) AS t, sum(Outcome) AS w FROM sided GROUP BY Season, A_home"
#: a fold's rows are predicted by the venue means of the other folds
fx.SQL["oofm"] = "SELECT a.Season, a.A_home, any_value(a.n) AS n, any_value(a.w) AS w, sum(b.m) / sum(b.n) AS pm, sum(b.t) / sum(b.n) AS pt FROM venues a JOIN venues b ON b.Season <> a.Season AND b.A_home = a.A_home GROUP BY a.Season, a.A_home"
fx.SQL["cal0"] = "SELECT DISTINCT Season AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM oofm"
_STEPS = 12
for _i in range(_STEPS):  # Newton's method for each fold's calibrator, on the other folds' out-of-fold margins
    fx.SQL[f"cal{_i + 1}"] = (
        "SELECT k, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM ("
        "SELECT k, a, b, sum((n * p - w) * pm) + a AS ga, sum(n * p - w) AS gb, sum(n * p * (1 - p) * pm * pm) + 1 AS haa, sum(n * p * (1 - p) * pm) AS hab, sum(n * p * (1 - p)) AS hbb FROM ("
        f"SELECT c.k, c.a, c.b, o.pm, o.n, o.w, 1 / (1 + exp(-(c.a * o.pm + c.b))) AS p FROM cal{_i} c JOIN oofm o ON o.Season <> c.k) GROUP BY k, a, b)"
    )
fx.SQL["oofp"] = f"SELECT Season, A_home, n, w, pm, pt, 1 / (1 + exp(-(a * pm + b))) AS p FROM oofm JOIN cal{_STEPS} ON k = Season"


def venue_games(spark, d):
    """All games from both sides, with the venue and a constant."""
    g = fx.game_raw(spark, d)
    diff, total = F.col("WScore") - F.col("LScore"), F.col("WScore") + F.col("LScore")

    def side(a_won: bool):
        s, a, b = (1, "W", "L") if a_won else (-1, "L", "W")
        return F.struct(F.col(f"{a}TeamID").alias("A_TeamID"), F.col(f"{b}TeamID").alias("B_TeamID"), (s * diff).cast("double").alias("Margin"), total.cast("double").alias("Total"), F.lit(int(a_won)).alias("Outcome"), scores.home_sign(F.col("WLoc"), a_won).cast("double").alias("A_home"), F.lit(0.0).alias("constant"))

    return g.select("_seq", "Season", "men_women", "DayNum", F.explode(F.array(side(True), side(False))).alias("r")).select("_seq", "Season", "men_women", "DayNum", "r.*")


@query("m1_fold_predictions", "oofp", "SELECT Season, A_home, n, pm AS pred_margin, pt AS pred_total, round(p, 4) AS pred_prob, round((w * (1 - p) * (1 - p) + (n - w) * p * p) / n, 4) AS brier FROM oofp", "pred_margin pred_total")
def _(spark, d):
    """Both heads and the cross-fitted calibrator, out of fold: a fold that leaks, swapped heads or a calibrator fitted on its own fold change the numbers."""
    oof = tr.leave_one_out(venue_games(spark, d), ["A_home"], EXACT)
    return oof.groupBy("Season", F.col("A_home").cast("int").alias("A_home")).agg(F.count(F.lit(1)).alias("n"), F.avg("pred_margin").alias("pred_margin"), F.avg("pred_total").alias("pred_total"), F.round(F.avg("pred_prob"), 4).alias("pred_prob"), F.round(metrics.brier("pred_prob", "Outcome"), 4).alias("brier"))


@query("m5_m6_log_predictions", "venues", "SELECT CASE WHEN a.Season < 2001 THEN 'oof' ELSE 'holdout' END AS source, a.Season, a.A_home, any_value(a.n) AS n, sum(b.m) / sum(b.n) AS pred_margin, sum(b.t) / sum(b.n) AS pred_total FROM venues a JOIN venues b ON b.Season < 2001 AND b.Season <> a.Season AND b.A_home = a.A_home GROUP BY a.Season, a.A_home", "pred_margin pred_total")
def _(spark, d):
    """The log of out-of-fold and holdout predictions: the holdout season is seen by no model."""
    g = pinned(venue_games(spark, d), ["Season"])
    oof = tr.leave_one_out(g, ["A_home"], EXACT, holdout=[2001], written=True).select(*tr.IDENTITY, "A_home", "pred_margin", "pred_total", "pred_prob")
    held = tr.train(g.where("Season < 2001"), ["A_home"], EXACT, written=True).transform(g.where("Season = 2001"))
    log = tr.predictions_log(oof, held).join(g.select("_seq", "A_TeamID", "A_home"), ["_seq", "A_TeamID"])
    return log.groupBy("source", "Season", F.col("A_home").cast("int").alias("A_home")).agg(F.count(F.lit(1)).alias("n"), F.avg("pred_margin").alias("pred_margin"), F.avg("pred_total").alias("pred_total"))


@query("m17_ablation_scores", "sided oofp venues", "SELECT 'with' AS variant, count(*) AS n, avg(abs(Margin - pm)) AS mae_margin, avg(abs(Total - pt)) AS mae_total, round(avg((Outcome - p) ** 2), 4) AS brier FROM sided JOIN oofp USING (Season, A_home) UNION ALL SELECT 'without', count(*), avg(abs(Margin)), avg(abs(Total - pt)), 0.25 FROM sided JOIN (SELECT a.Season, sum(b.t) / sum(b.n) AS pt FROM (SELECT DISTINCT Season FROM venues) a JOIN venues b ON b.Season <> a.Season GROUP BY a.Season) USING (Season)", "mae_margin mae_total")
def _(spark, d):
    """What the venue is worth: scores of the same folds with it and with a constant in its place."""
    g = pinned(venue_games(spark, d), ["Season"])
    parts = []
    for label, features in (("with", ["A_home"]), ("without", ["constant"])):
        oof = tr.leave_one_out(g, features, EXACT, written=True)
        mae = {f"mae_{c.lower()}": F.avg(F.abs(F.col(c) - F.col(f"pred_{c.lower()}"))) for c in ("Margin", "Total")}
        parts.append(oof.agg(F.count(F.lit(1)).alias("n"), *[x.alias(c) for c, x in mae.items()], F.round(metrics.brier("pred_prob", "Outcome"), 4).alias("brier")).select(F.lit(label).alias("variant"), "*"))
    return parts[0].unionByName(parts[1])


@query("a32_home_edge_value", "venues", "SELECT (SELECT sum(n)::BIGINT FROM venues WHERE Season = 2001) AS n_rows, sum(m) FILTER (A_home = 1) / sum(n) FILTER (A_home = 1) - sum(m) FILTER (A_home = -1) / sum(n) FILTER (A_home = -1) AS edge FROM venues WHERE Season < 2001", "edge")
def _(spark, d):
    """The home edge in points: two counterfactual copies of a season through a model of the earlier ones."""
    g = venue_games(spark, d)
    model = tr.train(g.where("Season < 2001"), ["A_home"], EXACT)
    both = g.where("Season = 2001").drop("A_home").withColumn("A_home", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    margin = lambda v: F.avg(F.when(F.col("A_home") == v, F.col("pred_margin")))
    return model.transform(both).agg((F.count(F.lit(1)) / 2).cast("long").alias("n_rows"), (margin(1.0) - margin(-1.0)).alias("edge"))


@query("m13_fold_spread", "venues", "SELECT A_home, any_value(n) AS n, avg(pm) AS spread FROM (SELECT v.A_home, v.n, k.Season AS k, sum(b.m) / sum(b.n) AS pm FROM venues v, (SELECT DISTINCT Season FROM venues WHERE Season < 2001) k, venues b WHERE v.Season = 2001 AND b.Season < 2001 AND b.Season <> k.Season AND b.A_home = v.A_home GROUP BY ALL) GROUP BY A_home", "spread")
def _(spark, d):
    """The mean of the fold models' spreads for an unseen season."""
    g = pinned(venue_games(spark, d), ["Season"])
    own = g.where("Season = 2001")
    models = tr.fold_models(g.where("Season < 2001"), ["A_home"], EXACT, written=True)
    for i, m in enumerate(models):
        own = m.transform(own).withColumnRenamed("pred_margin", f"m{i}")
    spread = sum(F.col(f"m{i}") for i in range(len(models))) / len(models)
    return own.groupBy(F.col("A_home").cast("int").alias("A_home")).agg(F.count(F.lit(1)).alias("n"), F.avg(spread).alias("spread"))


@query("m14_known_importances", "venues", "SELECT feature, (CASE WHEN feature = 'A_home' THEN 1 ELSE 0 END)::DOUBLE AS importance, folds FROM (SELECT unnest(['A_home', 'constant']) AS feature, (SELECT count(DISTINCT Season) FROM venues WHERE Season < 2001) AS folds)", "importance")
def _(spark, d):
    """Mean importances where the answer is known: the constant can split nothing."""
    models = tr.fold_models(venue_games(spark, d).where("Season < 2001"), ["constant", "A_home"], EXACT)
    return tr.importances(models, ["constant", "A_home"], spark).withColumn("folds", F.lit(len(models)).cast("long"))


# --- leave-one-tournament-out as a whole: weights, in-fold calibrators, temperatures by segment, market blend

_loo_weight = "CASE WHEN Season >= 1998 THEN 1.5 + (Season - 1998) / greatest(1, max(Season) OVER () - 1998)::DOUBLE * 1.5 ELSE 1.0 END"
_fair = "ph / (ph + pv)"
fx.SQL["tourney"] = f"""SELECT s._seq, s.Season, g.men_women, s.Outcome, s.A_home, s.Margin, w.w, abs(a.SeedNum - b.SeedNum) AS gap, coalesce(a.SeedNum = b.SeedNum, false) AS playin,
 CASE WHEN s._seq % 3 = 0 THEN CASE WHEN i.home_id = CASE WHEN s.Outcome = 1 THEN WTeamID ELSE LTeamID END THEN {_fair} ELSE 1 - {_fair} END END AS v
 FROM sided s JOIN game_raw g USING (_seq) JOIN (SELECT _seq, {_loo_weight} AS w FROM game_raw WHERE DayNum >= 134) w USING (_seq) LEFT JOIN implied i ON i._seq = s._seq
 LEFT JOIN seednum a ON a.men_women = g.men_women AND a.Season = g.Season AND a.TeamID = CASE WHEN s.Outcome = 1 THEN WTeamID ELSE LTeamID END
 LEFT JOIN seednum b ON b.men_women = g.men_women AND b.Season = g.Season AND b.TeamID = CASE WHEN s.Outcome = 1 THEN LTeamID ELSE WTeamID END"""
#: each fold's regressor: weighted means by venue of the other seasons; and what its calibrator sees
fx.SQL["lotom"] = "SELECT k.Season AS k, t.A_home, sum(t.w * t.Margin) / sum(t.w) AS pm, count(*) AS n, sum(t.Outcome) AS won FROM (SELECT DISTINCT Season FROM tourney) k JOIN tourney t ON t.Season <> k.Season GROUP BY k.Season, t.A_home"
fx.SQL["lotoc0"] = "SELECT DISTINCT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM lotom"
for _i in range(_STEPS):
    fx.SQL[f"lotoc{_i + 1}"] = (
        "SELECT k, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM ("
        "SELECT k, a, b, sum((n * p - won) * pm) + a AS ga, sum(n * p - won) AS gb, sum(n * p * (1 - p) * pm * pm) + 1 AS haa, sum(n * p * (1 - p) * pm) AS hab, sum(n * p * (1 - p)) AS hbb FROM ("
        f"SELECT c.k, c.a, c.b, o.pm, o.n, o.won, 1 / (1 + exp(-(c.a * o.pm + c.b))) AS p FROM lotoc{_i} c JOIN lotom o USING (k)) GROUP BY k, a, b)"
    )
fx.SQL["lotor"] = f"SELECT t.*, CASE men_women WHEN 0 THEN 'M' ELSE 'W' END || CASE WHEN NOT playin AND gap > CASE men_women WHEN 0 THEN 10 ELSE 8 END THEN '_wide' ELSE '_close' END AS segment, 1 / (1 + exp(-(c.a * m.pm + c.b))) AS raw FROM tourney t JOIN lotom m ON m.k = t.Season AND m.A_home = t.A_home JOIN lotoc{_STEPS} c ON c.k = t.Season"
_heat = "1.0 / (1.0 + exp(-ln(raw / (1.0 - raw)) / {t}))"


def _closing_grids(name: str, rows: str, key: str, loss: str, low: str, high: str, points: int = 33, rounds: int = 4) -> str:
    """Registers grids that close in on the least weighted loss as CTEs name0, name1, ...; the last one has (key, t)."""
    fx.SQL[f"{name}0"] = f"SELECT {key}, {low} AS lo, {high} AS hi, {low} AS low, ({high} - {low}) / {points - 1} AS step, 0.0::DOUBLE AS t FROM {rows} GROUP BY {key}"
    for k in range(rounds):
        each = f"SELECT g.{key}, lo, hi, step, low + step * i AS t, sum(w * {loss.format(t='(low + step * i)')}) / sum(w) AS l FROM {name}{k} g JOIN {rows} r ON r.{key} = g.{key}, range({points}) grid(i) GROUP BY ALL"
        fx.SQL[f"{name}{k + 1}"] = f"SELECT {key}, lo, hi, greatest(lo, t - step) AS low, (least(hi, t + step) - greatest(lo, t - step)) / {points - 1} AS step, t FROM (SELECT {key}, lo, hi, step, arg_min(t, l) AS t FROM ({each}) GROUP BY ALL)"
    return f"{name}{rounds}"


fx.SQL["lotof"] = "SELECT segment, raw, Outcome, sum(w) AS w FROM lotor WHERE NOT playin GROUP BY ALL"
_T_LAST = _closing_grids("lotot", "lotof", "segment", f"({_heat} - Outcome) ** 2", "(CASE WHEN segment LIKE '%wide' THEN 0.05 ELSE 0.5 END)::DOUBLE", "5.0::DOUBLE")
fx.SQL["lotop"] = f"SELECT r.*, {_heat.format(t='coalesce(t, 1.0)')} AS p FROM lotor r LEFT JOIN {_T_LAST} USING (segment)"
fx.SQL["lotov"] = "SELECT 1 AS one, p, v, Outcome, w FROM lotop WHERE v IS NOT NULL"
_A_LAST = _closing_grids("lotoa", "lotov", "one", "({t} * p + (1 - {t}) * v - Outcome) ** 2", "0.0::DOUBLE", "1.0::DOUBLE", rounds=5)
fx.SQL["lotoq"] = f"SELECT Season, playin, w, Outcome, coalesce(a.t * p + (1 - a.t) * v, p) AS p FROM lotop, {_A_LAST} a"


def tournament_sides(spark, d):
    """Tournament games from both sides with venue, seeds, season weight and, for a third of them, the market's chance."""
    g = venue_games(spark, d).where("DayNum >= 134")
    seed = seed_numbers(spark, d).select("men_women", "Season", "TeamID", "SeedNum")
    teams = fx.game_raw(spark, d).select("_seq", "WTeamID", "LTeamID")
    g = g.join(teams, "_seq").withColumn("B_TeamID", F.when(F.col("A_TeamID") == F.col("WTeamID"), F.col("LTeamID")).otherwise(F.col("WTeamID"))).drop("WTeamID", "LTeamID")
    for s in "AB":
        g = g.join(seed.withColumnsRenamed({"TeamID": f"{s}_TeamID", "SeedNum": f"{s}_Seed"}), ["men_women", "Season", f"{s}_TeamID"], "left")
    top = g.agg(F.max("Season").alias("top"))
    recent = 1.5 + (F.col("Season") - 1998) / F.greatest(F.lit(1), F.col("top") - 1998) * 1.5
    g = g.crossJoin(F.broadcast(top)).withColumn("sample_weight", F.when(F.col("Season") >= 1998, recent).otherwise(1.0)).drop("top")  # one row
    home, vis = (scores.implied_probability(F.col(c)) for c in ("home_ml", "vis_ml"))
    m = fx.lines_market(spark, d).where("_seq % 3 = 0").select("_seq", "home_id", (home / (home + vis)).alias("fair"))
    return g.join(m, "_seq", "left").withColumn("market_prob", F.when(F.col("home_id") == F.col("A_TeamID"), F.col("fair")).otherwise(1 - F.col("fair"))).drop("home_id", "fair")


@query(
    "m1_segments_and_market",
    f"lotoq {_T_LAST} {_A_LAST}",
    f"SELECT 'temperature ' || segment AS what, round(t, 3) AS value FROM {_T_LAST} UNION ALL SELECT 'market weight', round(t, 3) FROM {_A_LAST} UNION ALL SELECT 'brier', round(sum(w * (p - Outcome) ** 2) / sum(w), 5) FROM lotoq WHERE NOT playin UNION ALL SELECT 'brier ' || Season, round(avg((p - Outcome) ** 2), 5) FROM lotoq WHERE NOT playin GROUP BY Season",
)
def _(spark, d):
    """Season weights, in-fold calibrators, four temperatures, the market's share and Brier scores without play-ins: every number that leaving one tournament out gives."""
    t = tournament.leave_one_tournament_out(tournament_sides(spark, d), ["A_home"], EXACT)
    fitted = {**{f"temperature {k}": v for k, v in t.temperatures.items()}, "market weight": t.market_weight}
    scored = {"brier": t.brier, **{f"brier {k}": v for k, v in t.by_season.items()}}
    told = [(k, float(v), 3) for k, v in fitted.items()] + [(k, float(v), 5) for k, v in scored.items()]
    return spark.createDataFrame(told, "what string, value double, places int").select("what", F.when(F.col("places") == 3, F.round("value", 3)).otherwise(F.round("value", 5)).alias("value"))  # a few numbers
