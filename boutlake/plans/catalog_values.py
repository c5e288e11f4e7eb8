"""Model queries whose every number SQL computes: quotes of all games, a whole field's pairs, the frozen tournament, leaves, and the quick model.

The models have one feature of three values, where a forest's leaves are means. SQL fits
the calibrator by Newton's method on the leaves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlake.model import handicap, leaves
from boutlake.model import training as tr
from boutlake.operators import asof, history, match, metrics, symmetric, teams
from boutlake.plans import fixtures as fx
from boutlake.plans.catalog_joins import field
from boutlake.plans.catalog_model import EXACT, venue_games
from boutlake.plans.registry import query
from boutlake.tables import pinned

STEPS = 12


def _calibrators(name: str, leaves: str) -> str:
    """Registers Newton's steps of a calibrator for each ``k`` of ``leaves`` (k, pm, n, won), penalty 1; the name of the last (k, a, b)."""
    fx.SQL[f"{name}0"] = f"SELECT DISTINCT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {leaves}"
    for i in range(STEPS):
        rows = f"SELECT c.k, c.a, c.b, o.pm, o.n, o.won, 1 / (1 + exp(-(c.a * o.pm + c.b))) AS p FROM {name}{i} c JOIN {leaves} o USING (k)"
        sums = f"SELECT k, a, b, sum((n * p - won) * pm) + a AS ga, sum(n * p - won) AS gb, sum(n * p * (1 - p) * pm * pm) + 1 AS haa, sum(n * p * (1 - p) * pm) AS hab, sum(n * p * (1 - p)) AS hbb FROM ({rows}) GROUP BY k, a, b"
        fx.SQL[f"{name}{i + 1}"] = f"SELECT k, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM ({sums})"
    return f"{name}{STEPS}"


# --- quotes of all games by a model of the seasons before 2001

fx.SQL["quoteleaf"] = "SELECT 1 AS k, A_home, sum(m) / sum(n) AS pm, sum(t) / sum(n) AS pt, sum(n) AS n, sum(w) AS won FROM venues WHERE Season < 2001 GROUP BY A_home"
_quote_cal = _calibrators("quotecal", "quoteleaf")
fx.SQL["quotes"] = f"SELECT A_home, round(pm, 6) + 0.0 AS pm, pt, round(1 / (1 + exp(-(a * pm + b))), 4) AS p FROM quoteleaf JOIN {_quote_cal} USING (k)"
_side_a = "SELECT *, least(WTeamID, LTeamID) AS a, greatest(WTeamID, LTeamID) AS b, (CASE WLoc WHEN 'H' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) * CASE WHEN WTeamID < LTeamID THEN 1 ELSE -1 END AS A_home FROM game_raw"
_line = "round_even(CASE WHEN {0} >= 0.5 THEN -100.0 * {0} / (1.0 - {0}) ELSE 100.0 * (1.0 - {0}) / {0} END, 0)::INT"
_within = "least(greatest({0}, 0.01), 0.99)".format
QUOTED = "score_a score_b line chance_a chance_b market_a gap"


@query(
    "m2_m4_m10_quotes",
    "quotes implied",
    f"SELECT g._seq, g.Season, g.DayNum, g.a AS A_TeamID, g.b AS B_TeamID, (pt + pm) / 2 AS score_a, (pt - pm) / 2 AS score_b, CASE WHEN pm > 0 THEN g.a ELSE g.b END AS favourite, -abs(pm) AS line, p AS chance_a, 1 - p AS chance_b, {_line.format(_within('p'))} AS moneyline_a, {_line.format(_within('round(1 - p, 4)'))} AS moneyline_b, market_a, p - market_a AS gap"
    f" FROM ({_side_a}) g JOIN quotes USING (A_home) LEFT JOIN (SELECT i._seq, CASE WHEN i.home_id < i.vis_id THEN ph / (ph + pv) ELSE 1 - ph / (ph + pv) END AS market_a FROM implied i) USING (_seq)",
    QUOTED,
)
def _(spark, d):
    """Scores, favourite, line, chances, moneylines and the gap to the market of every game, by a model of the seasons before the last."""
    g = venue_games(spark, d)
    model = tr.train(g.where("Season < 2001"), ["A_home"], EXACT)
    told = handicap.gap_to_market(handicap.quoted(model.transform(symmetric.one_orientation(g))), fx.lines_market(spark, d))
    return told.select("_seq", "Season", "DayNum", "A_TeamID", "B_TeamID", "score_a", "score_b", "favourite", "line", "chance_a", "chance_b", "moneyline_a", "moneyline_b", "market_a", "gap")


# --- a field's pairs: which side's average margin before the bracket is greater by more than two points

_better = "(CASE WHEN a.avg_PointDiff - b.avg_PointDiff > 2 THEN 1 WHEN a.avg_PointDiff - b.avg_PointDiff < -2 THEN -1 ELSE 0 END)"
_averages = " LEFT JOIN avgs a ON a.men_women = {0}.men_women AND a.Season = {0}.Season AND a.TeamID = {1} LEFT JOIN avgs b ON b.men_women = {0}.men_women AND b.Season = {0}.Season AND b.TeamID = {2}"
fx.SQL["fieldrows"] = f"SELECT t.Season, t.Outcome, t.PointDiff, t.T1_Score + t.T2_Score AS Total, {_better} AS better FROM tourn t" + _averages.format("t", "t.T1_TeamID", "t.T2_TeamID")
fx.SQL["fieldleaf"] = "SELECT 1 AS k, better, avg(PointDiff) AS pm, avg(Total) AS pt, count(*) AS n, sum(Outcome) AS won FROM fieldrows GROUP BY better"
_field_cal = _calibrators("fieldcal", "fieldleaf")
fx.SQL["fieldp"] = f"SELECT better, pm, pt, round(1 / (1 + exp(-(a * pm + b))), 4) AS p FROM fieldleaf JOIN {_field_cal} USING (k)"
fx.SQL["fieldpairs"] = f"SELECT x.Season, x.men_women, x.TeamID AS A_TeamID, y.TeamID AS B_TeamID, {_better} AS better FROM seeds x JOIN seeds y ON x.Season = y.Season AND x.men_women = y.men_women AND x.TeamID < y.TeamID" + _averages.format("x", "x.TeamID", "y.TeamID") + " WHERE x.r <= 68 AND y.r <= 68"


def with_better(log, averages):
    """``better``: 1 or -1 where the sides' averages before the bracket are more than two points apart, else 0, as for an unknown side."""
    x = symmetric.fan_out(symmetric.attach_both(log, averages, teams.KEYS, ["avg_PointDiff"]), ["avg_PointDiff"])
    gap = F.col("d_avg_PointDiff")
    return x.withColumn("better", F.when(gap > 2, 1.0).when(gap < -2, -1.0).otherwise(0.0))


@query(
    "m9_field_pair_values",
    "fieldpairs fieldp",
    "SELECT f.Season, f.men_women, f.A_TeamID, f.B_TeamID, p.pm AS pred_margin, p.pt AS pred_total, p.p AS chance_a, q.p AS chance_b, round(p.p + q.p, 4) AS both_sides FROM fieldpairs f JOIN fieldp p ON p.better = f.better JOIN fieldp q ON q.better = -f.better",
    "pred_margin pred_total chance_a chance_b both_sides",
)
def _(spark, d):
    """Every season's whole field without results through the training path, each pair from both sides; the model has seen all tournaments."""
    averages = pinned(teams.season_averages(fx.reg(spark, d), ("Score",)))  # joined four times
    played = fx.tourn(spark, d).select("_seq", "Season", "men_women", F.col("T1_TeamID").alias("A_TeamID"), F.col("T2_TeamID").alias("B_TeamID"), "Outcome", F.col("PointDiff").alias("Margin"), (F.col("T1_Score") + F.col("T2_Score")).alias("Total"))
    model = tr.train(with_better(played, averages), ["better"], EXACT)
    pairs = match.field_pairs(field(spark, d))
    mirrored = pairs.select("Season", "men_women", F.col("B_TeamID").alias("A_TeamID"), F.col("A_TeamID").alias("B_TeamID"))
    told = model.transform(with_better(pairs.unionByName(mirrored), averages))
    of_a = F.col("A_TeamID") < F.col("B_TeamID")
    own = lambda c: F.max(F.when(of_a, F.col(c))).alias(c)
    both = told.groupBy("Season", "men_women", F.least("A_TeamID", "B_TeamID").alias("_a"), F.greatest("A_TeamID", "B_TeamID").alias("_b")).agg(own("pred_margin"), own("pred_total"), F.round(F.max(F.when(of_a, F.col("pred_prob"))), 4).alias("chance_a"), F.round(F.max(F.when(~of_a, F.col("pred_prob"))), 4).alias("chance_b"))
    return both.withColumnsRenamed({"_a": "A_TeamID", "_b": "B_TeamID"}).withColumn("both_sides", F.round(F.col("chance_a") + F.col("chance_b"), 4))


# --- every tournament by a model of the other seasons' tournaments, with ratings frozen the day before it

fx.SQL["frozen"] = (
    "SELECT s.*, dense_rank() OVER (PARTITION BY g.Season, g.men_women ORDER BY g.DayNum)::INT AS round_num, CASE WHEN x.r - y.r > 2 THEN 1 WHEN x.r - y.r < -2 THEN -1 ELSE 0 END AS better FROM sided s JOIN game_raw g USING (_seq)"
    + "".join(f" LEFT JOIN (SELECT Season, TeamID, arg_max(kp_AdjEM_asof, ArchiveDate) AS r FROM snaps WHERE ArchiveDate < make_date(Season, 1, 1) + 134 GROUP BY ALL) {t} ON {t}.Season = g.Season AND {t}.TeamID = CASE WHEN s.Outcome = {won} THEN WTeamID ELSE LTeamID END" for t, won in (("x", 1), ("y", 0)))
    + " WHERE g.DayNum >= 134"
)
fx.SQL["frozensum"] = "SELECT Season, better, sum(Margin) AS m, sum(Total) AS t, count(*) AS n, sum(Outcome) AS won FROM frozen GROUP BY Season, better"
fx.SQL["frozenleaf"] = "SELECT a.Season, a.better, any_value(a.n) AS n, any_value(a.won) AS won, sum(b.m) / sum(b.n) AS pm, sum(b.t) / sum(b.n) AS pt FROM frozensum a JOIN frozensum b ON b.Season <> a.Season AND b.better = a.better GROUP BY a.Season, a.better"
fx.SQL["frozenfit"] = "SELECT c.Season AS k, o.pm, o.n, o.won FROM (SELECT DISTINCT Season FROM frozenleaf) c JOIN frozenleaf o ON o.Season <> c.Season"
_frozen_cal = _calibrators("frozencal", "frozenfit")
fx.SQL["frozenp"] = f"SELECT Season, better, pm, pt, round(1 / (1 + exp(-(a * pm + b))), 4) AS p FROM frozenleaf JOIN {_frozen_cal} ON k = Season"


@query(
    "m18_frozen_values",
    "frozen frozenp",
    "SELECT round_num, A_home, count(*) AS n, avg((p - Outcome) ** 2) AS brier, avg(abs(pm - Margin)) AS mae_margin, avg(abs(pt - Total)) AS mae_total FROM frozen JOIN frozenp USING (Season, better) GROUP BY round_num, A_home",
    "brier mae_margin mae_total",
)
def _(spark, d):
    """Scores of all seasons' tournaments by round and venue: ratings as of the day before the first round, each season by a model of the others."""
    g = history.with_round_numbers(pinned(venue_games(spark, d).where("DayNum >= 134")), ["Season", "men_women"])
    x = asof.frozen_both(g, fx.snaps(spark, d), ["kp_AdjEM_asof"], fx.cal(spark, d), 134)
    gap = F.col("d_kp_AdjEM_asof")
    x = x.withColumn("better", F.when(gap > 2, 1.0).when(gap < -2, -1.0).otherwise(0.0))
    oof = tr.leave_one_out(x, ["better"], EXACT).withColumn("p", F.round("pred_prob", 4))
    return oof.groupBy("round_num", F.col("A_home").cast("int").alias("A_home")).agg(F.count(F.lit(1)).alias("n"), metrics.brier("p", "Outcome").alias("brier"), F.avg(F.abs(F.col("pred_margin") - F.col("Margin"))).alias("mae_margin"), F.avg(F.abs(F.col("pred_total") - F.col("Total"))).alias("mae_total"))


# --- calibration on leaves: a tree on the venue has a leaf for each, so SQL knows the words, their weights and the fit

_counts = "SELECT A_home, sum(n)::DOUBLE AS n, sum(w)::DOUBLE AS won, (sum(sum(n)) OVER ())::DOUBLE AS allrows FROM venues WHERE Season < 2001 GROUP BY A_home"
fx.SQL["leafcal0"] = f"SELECT *, ln((allrows + 1) / (n + 1)) AS z, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS b FROM ({_counts})"
for _i in range(STEPS):  # Newton's method: leaves meet in the intercept only, which is eliminated first
    _rows = f"SELECT *, 1 / (1 + exp(-(b + beta * z))) AS p FROM leafcal{_i}"
    _slopes = f"SELECT *, (n * p - won) * z / allrows + 0.01 * beta AS g, n * p * (1 - p) * z * z / allrows + 0.01 AS h, n * p * (1 - p) * z / allrows AS h0, sum((n * p - won) / allrows) OVER () AS g0, sum(n * p * (1 - p) / allrows) OVER () AS h00 FROM ({_rows})"
    _common = f"SELECT *, (g0 - sum(h0 * g / h) OVER ()) / (h00 - sum(h0 * h0 / h) OVER ()) AS d0 FROM ({_slopes})"
    fx.SQL[f"leafcal{_i + 1}"] = f"SELECT A_home, n, won, allrows, z, beta - (g - h0 * d0) / h AS beta, b - d0 AS b FROM ({_common})"


@query(
    "m12_leaf_values",
    f"sided leafcal{STEPS}",
    f"SELECT Season, A_home, count(*) AS n, any_value(p) AS pred_prob, avg((p - Outcome) ** 2) AS brier FROM sided JOIN (SELECT A_home, round(1 / (1 + exp(-(b + beta * z))), 4) AS p FROM leafcal{STEPS}) USING (A_home) GROUP BY Season, A_home",
    "pred_prob brier",
)
def _(spark, d):
    """Every season scored by a leaf calibration of the seasons before the last."""
    g = venue_games(spark, d)
    model = leaves.fit_leaves(g.where("Season < 2001"), ["A_home"], tr.Settings(trees=1, depth=3, step=1.0, subsample=1.0))
    told = model.transform(g).withColumn("p", F.round("pred_prob", 4))
    return told.groupBy("Season", F.col("A_home").cast("int").alias("A_home")).agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("pred_prob"), metrics.brier("p", "Outcome").alias("brier"))


# --- the quick model: a logistic model on the logged margins, a fifth of the games held out by a hash of their number

fx.SQL["quickrows"] = "SELECT Season, Outcome, pred_margin AS pm, ('0x' || substr(md5(_seq::VARCHAR), 1, 8))::BIGINT % 5 = 0 AS held_out FROM plog"
fx.SQL["quickfit"] = "SELECT 1 AS k, pm, count(*) AS n, sum(Outcome) AS won FROM quickrows WHERE NOT held_out GROUP BY pm"
_quick_cal = _calibrators("quickcal", "quickfit")


@query(
    "m15_quick_values",
    f"quickrows {_quick_cal}",
    f"SELECT Season, held_out, count(*) AS n, avg(p) AS mean_chance, avg((p - Outcome) ** 2) AS brier, avg(((p >= 0.5) = (Outcome = 1))::INT) AS accuracy FROM (SELECT q.*, round(1 / (1 + exp(-(a * pm + b))), 4) AS p FROM quickrows q, {_quick_cal}) GROUP BY Season, held_out",
    "mean_chance brier accuracy",
)
def _(spark, d):
    """Scores of the fitted and the held-out games of every season."""
    g = fx.plog(spark, d).withColumn("held_out", tr.held_by_key("_seq"))
    told = tr.probability(g, tr.fit_calibrator(g.where("NOT held_out"), EXACT), out="q").withColumn("p", F.round("q", 4))
    right = ((F.col("p") >= 0.5) == (F.col("Outcome") == 1)).cast("int")
    return told.groupBy("Season", "held_out").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_chance"), metrics.brier("p", "Outcome").alias("brier"), F.avg(right).alias("accuracy"))
