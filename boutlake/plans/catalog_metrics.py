"""Queries on accuracy, calibration, drift and publishing (A10 on)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from boutlake.functions import scores
from boutlake.operators import history, metrics, teams
from boutlake.plans import fixtures as fx
from boutlake.plans.catalog_joins import matched, ratings_log
from boutlake.plans.catalog_log import BOX, bucketed, rolling_ab, season_ratings, seed_gap
from boutlake.plans.registry import query

SCORES = "avg(abs({p}_margin - Margin)) AS margin_mae, avg(abs({p}_total - Total)) AS total_mae, avg(({p}_prob - Outcome) * ({p}_prob - Outcome)) AS brier, avg((({p}_prob > 0.5) = (Outcome = 1))::INT) AS win_acc, count(*) AS n"
SCORED = "margin_mae total_mae brier win_acc"


@query("a10_brier_by_season", "plog", "SELECT Season, avg((pred_prob - Outcome) * (pred_prob - Outcome)) AS brier, count(*) AS n FROM plog GROUP BY ROLLUP (Season)", "brier")
def _(spark, d):
    """Every season and all together."""
    return fx.plog(spark, d).rollup("Season").agg(metrics.brier("pred_prob", "Outcome").alias("brier"), F.count(F.lit(1)).alias("n"))


@query("a10_mean_of_seasons", "plog", "SELECT avg(b) AS brier FROM (SELECT avg((pred_prob - Outcome) * (pred_prob - Outcome)) AS b FROM plog GROUP BY Season)", "brier")
def _(spark, d):
    return fx.plog(spark, d).groupBy("Season").agg(metrics.brier("pred_prob", "Outcome").alias("b")).agg(F.avg("b").alias("brier"))


@query("a11_weighted_brier", "plog", "SELECT sum((Season - 1990) * (pred_prob - Outcome) * (pred_prob - Outcome)) / sum(Season - 1990) AS brier FROM plog", "brier")
def _(spark, d):
    w = F.col("Season") - 1990
    return fx.plog(spark, d).agg((F.sum(w * (F.col("pred_prob") - F.col("Outcome")) ** 2) / F.sum(w)).alias("brier"))


@query("a12_calibration_error", "plog", "SELECT sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT least(floor(pred_prob * 10), 9) AS b, count(*) AS n, avg(pred_prob) AS mp, avg(Outcome) AS my FROM plog GROUP BY b)", "ece")
def _(spark, d):
    return metrics.expected_calibration_error(fx.plog(spark, d), "pred_prob", "Outcome")


@query("a13_prediction_scores", "matched", f"SELECT 'pred' AS who, {SCORES.format(p='pred')} FROM matched UNION ALL SELECT 'cmp', {SCORES.format(p='cmp')} FROM matched", SCORED)
def _(spark, d):
    m = matched(spark, d)
    return m.agg(*metrics.prediction_scores("pred")).select(F.lit("pred").alias("who"), "*").unionByName(m.agg(*metrics.prediction_scores("cmp")).select(F.lit("cmp").alias("who"), "*"))


@query("a13_logistic_loss", "plog", "SELECT avg(-(Outcome * ln(q) + (1 - Outcome) * ln(1 - q))) AS log_loss FROM (SELECT *, least(greatest(pred_prob, 1e-7), 1 - 1e-7) AS q FROM plog)", "log_loss")
def _(spark, d):
    return fx.plog(spark, d).agg(metrics.log_loss("pred_prob", "Outcome").alias("log_loss"))


@query("a14_naive_floors", "plog", "SELECT avg(abs(Margin)) AS naive_margin, avg(abs(Total - t)) AS naive_total, avg((0.5 - Outcome) * (0.5 - Outcome)) AS naive_brier, 1 - avg(abs(pred_margin - Margin)) / avg(abs(Margin)) AS skill FROM plog, (SELECT avg(Total) AS t FROM plog)", "naive_margin naive_total naive_brier skill")
def _(spark, d):
    p = fx.plog(spark, d)
    mean = p.agg(F.avg("Total").alias("t"))
    naive = F.avg(F.abs("Margin"))
    return p.crossJoin(F.broadcast(mean)).agg(naive.alias("naive_margin"), F.avg(F.abs(F.col("Total") - F.col("t"))).alias("naive_total"), metrics.brier(F.lit(0.5), "Outcome").alias("naive_brier"), (1 - F.avg(F.abs(F.col("pred_margin") - F.col("Margin"))) / naive).alias("skill"))  # one row


@query("a15_report_by_dimension", "plog buckets", f"SELECT phase, {SCORES.format(p='pred')} FROM plog JOIN (SELECT _seq, phase FROM buckets) USING (_seq) GROUP BY phase", SCORED)
def _(spark, d):
    return bucketed(spark, d).groupBy("phase").agg(*metrics.prediction_scores("pred"))


@query("a16_segment_table", "plog buckets", f"SELECT phase, margin_bin, spread_bin, pool, {SCORES.format(p='pred')} FROM (SELECT p.*, phase, margin_bin, spread_bin, p.men_women AS pool FROM plog p JOIN buckets b USING (_seq)) GROUP BY GROUPING SETS ((), (phase), (margin_bin), (spread_bin), (pool))", SCORED)
def _(spark, d):
    """One pass for the overall row and each dimension's rows."""
    b = bucketed(spark, d).withColumn("pool", F.col("men_women"))
    dims = [F.col(c) for c in ("phase", "margin_bin", "spread_bin", "pool")]
    return b.groupingSets([[], *[[c] for c in dims]], *dims).agg(*metrics.prediction_scores("pred"))


@query("a17_conditional_scores", "plog", "SELECT avg((pred_prob - Outcome) * (pred_prob - Outcome)) AS brier, avg((pred_prob - Outcome) * (pred_prob - Outcome)) FILTER (men_women = 1) AS brier_w, avg(abs(pred_margin - Margin)) FILTER (DayNum < 45) AS early_mae, count(*) FILTER (DayNum < 45) AS n_early FROM plog WHERE source = 'holdout'", "brier brier_w early_mae")
def _(spark, d):
    loss = (F.col("pred_prob") - F.col("Outcome")) ** 2
    early = F.col("DayNum") < 45
    return fx.plog(spark, d).where("source = 'holdout'").agg(F.avg(loss).alias("brier"), F.avg(F.when(F.col("men_women") == 1, loss)).alias("brier_w"), F.avg(F.when(early, F.abs(F.col("pred_margin") - F.col("Margin")))).alias("early_mae"), F.count_if(early).alias("n_early"))


@query("a18_funnel", "plog matched", "SELECT (SELECT count(*) FROM plog) AS log, (SELECT count(*) FROM matched) AS matched, (SELECT count(*) FROM matched WHERE cmp_margin <> 0) AS with_pick, (SELECT count(*) FROM matched WHERE (cmp_margin > 0) = (Outcome = 1)) AS right_pick")
def _(spark, d):
    m = matched(spark, d, "left")
    hit = F.col("cmp_margin").isNotNull()
    return m.agg(F.count(F.lit(1)).alias("log"), F.count_if(hit).alias("matched"), F.count_if(hit & (F.col("cmp_margin") != 0)).alias("with_pick"), F.count_if(hit & ((F.col("cmp_margin") > 0) == (F.col("Outcome") == 1))).alias("right_pick"))


def slate_rows(spark, d):
    m = matched(spark, d, "left").where("Season = 2000")
    gap = F.abs(F.col("pred_margin") - F.col("cmp_margin"))
    return m.withColumn("gap", gap)


@query("a19_nested_slate", "plog matched", "SELECT DayNum, string_agg(_seq || ':' || coalesce(gap::INT::VARCHAR, '-'), ' ' ORDER BY gap DESC NULLS LAST, _seq) AS games FROM (SELECT p._seq, p.DayNum, abs(p.pred_margin - m.cmp_margin) AS gap FROM plog p LEFT JOIN matched m USING (_seq) WHERE p.Season = 2000) GROUP BY DayNum")
def _(spark, d):
    """A day's games as one array, the largest disagreement first, missing last."""
    key = F.struct(F.coalesce(-F.col("gap"), F.lit(float("inf"))).alias("k"), "_seq", F.concat_ws(":", F.col("_seq").cast("string"), F.coalesce(F.col("gap").cast("int").cast("string"), F.lit("-"))).alias("s"))
    return slate_rows(spark, d).groupBy("DayNum").agg(F.array_join(F.sort_array(F.collect_list(key)).getField("s"), " ").alias("games"))


@query("a20_nested_ratings", "ratings_log", "SELECT pool, Season, ArchiveDate, string_agg(TeamID::VARCHAR, ' ' ORDER BY our_rank, TeamID) AS teams FROM ratings_log GROUP BY ALL")
def _(spark, d):
    r = ratings_log(spark, d)
    return r.groupBy("pool", "Season", "ArchiveDate").agg(F.array_join(F.sort_array(F.collect_list(F.struct("our_rank", "TeamID"))).getField("TeamID").cast("array<string>"), " ").alias("teams"))


@query("a21_payload_meta", "plog", "SELECT Season, count(*) AS n_games, count(DISTINCT DayNum) AS n_days, min(DayNum) AS first_day, max(DayNum) AS last_day FROM plog GROUP BY Season")
def _(spark, d):
    days = F.sort_array(F.collect_set("DayNum"))  # at most 366 days
    p = fx.plog(spark, d).groupBy("Season").agg(F.count(F.lit(1)).alias("n_games"), days.alias("days"))
    return p.select("Season", "n_games", F.size("days").cast("long").alias("n_days"), F.col("days")[0].alias("first_day"), F.element_at("days", -1).alias("last_day"))


@query("a22_correlation_and_fit", "plog", "SELECT Season, corr(pred_margin, Margin) AS r, regr_slope(Margin, pred_margin) AS slope, regr_intercept(Margin, pred_margin) AS icept FROM plog GROUP BY Season", "r slope icept")
def _(spark, d):
    return fx.plog(spark, d).groupBy("Season").agg(F.corr("pred_margin", "Margin").alias("r"), F.regr_slope("Margin", "pred_margin").alias("slope"), F.regr_intercept("Margin", "pred_margin").alias("icept"))


_ranked = "SELECT source, Outcome, rank() OVER (PARTITION BY source ORDER BY pred_prob) + (count(*) OVER (PARTITION BY source, pred_prob) - 1) / 2.0 AS r FROM plog"
AUC_SQL = f"SELECT source, (sum(r) FILTER (Outcome = 1) - sum(Outcome) * (sum(Outcome) + 1) / 2.0) / (sum(Outcome) * sum(1 - Outcome)) AS auc FROM ({_ranked}) GROUP BY source"


@query("a23_auc", "plog", AUC_SQL, "auc")
def _(spark, d):
    return metrics.area_under_curve(fx.plog(spark, d), "pred_prob", "Outcome", ["source"])


@query("a24_conditional_ratios", "game_raw plog", "SELECT avg((WLoc = 'H')::INT) AS home_share, count(*) FILTER (NumOT > 0) AS n_ot, avg(((pred_prob > 0.5) = (Outcome = 1))::INT) FILTER (g.Season < 1998) AS acc_before, avg(((pred_prob > 0.5) = (Outcome = 1))::INT) FILTER (g.Season >= 1998) AS acc_after FROM game_raw g JOIN plog USING (_seq)", "home_share acc_before acc_after")
def _(spark, d):
    g = fx.game_raw(spark, d).select("_seq", "WLoc", "NumOT").join(fx.plog(spark, d), "_seq")
    right = ((F.col("pred_prob") > 0.5) == (F.col("Outcome") == 1)).cast("int")
    return g.agg(F.avg((F.col("WLoc") == "H").cast("int")).alias("home_share"), F.count_if(F.col("NumOT") > 0).alias("n_ot"), F.avg(F.when(F.col("Season") < 1998, right)).alias("acc_before"), F.avg(F.when(F.col("Season") >= 1998, right)).alias("acc_after"))


@query("a25_quantile_bins", "plog", "SELECT len(list_filter(e, lambda x: x < Total)) AS bin, count(*) AS n, avg(Margin) AS mean_margin FROM plog, (SELECT quantile_cont(Total, [0.25, 0.5, 0.75]) AS e FROM plog) GROUP BY bin", "mean_margin")
def _(spark, d):
    p = fx.plog(spark, d)
    e = metrics.exact_quantiles(p, "Total", [0.25, 0.5, 0.75]).withColumnRenamed("q", "e")
    b = F.size(F.filter("e", lambda x: x < F.col("Total"))).cast("long")
    return p.crossJoin(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("Margin").alias("mean_margin"))  # one row of edges


@query("a26_residual_pivot", "plog buckets", "SELECT margin_bin, avg(Margin - pred_margin) FILTER (phase = 'early') AS early, avg(Margin - pred_margin) FILTER (phase = 'mid') AS mid, avg(Margin - pred_margin) FILTER (phase = 'late') AS late FROM plog JOIN (SELECT _seq, phase, margin_bin FROM buckets) USING (_seq) GROUP BY margin_bin", "early mid late")
def _(spark, d):
    return bucketed(spark, d).groupBy("margin_bin").pivot("phase", ["early", "mid", "late"]).agg(F.avg(F.col("Margin") - F.col("pred_margin")))


@query("a26_top_cells", "plog buckets", "SELECT margin_bin, phase, avg(Margin - pred_margin) AS residual, count(*) AS n FROM plog JOIN (SELECT _seq, phase, margin_bin FROM buckets) USING (_seq) GROUP BY ALL HAVING count(*) >= 30 ORDER BY abs(avg(Margin - pred_margin)) DESC, margin_bin, phase LIMIT 5", "residual")
def _(spark, d):
    cells = bucketed(spark, d).groupBy("margin_bin", "phase").agg(F.avg(F.col("Margin") - F.col("pred_margin")).alias("residual"), F.count(F.lit(1)).alias("n")).where("n >= 30")
    return cells.orderBy(F.desc(F.abs("residual")), "margin_bin", "phase").limit(5)


_gapbin = "CASE WHEN abs(sd) <= 3 THEN 'close' WHEN abs(sd) <= 8 THEN 'mid' ELSE 'wide' END"


@query("a27_seed_bucket_calibration", "plog seedab", f"SELECT {_gapbin} AS gap, count(*) AS n, avg(pred_prob) AS mean_p, avg(Outcome) AS mean_y FROM plog JOIN seedab USING (_seq) WHERE sd IS NOT NULL GROUP BY gap", "mean_p mean_y")
def _(spark, d):
    g = fx.plog(spark, d).join(seed_gap(spark, d), "_seq").where("sd IS NOT NULL")
    gap = F.when(F.abs("sd") <= 3, "close").when(F.abs("sd") <= 8, "mid").otherwise("wide")
    return g.groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.avg("pred_prob").alias("mean_p"), F.avg("Outcome").alias("mean_y"))


@query("a28_loss_tables", "plog seedab", f"SELECT {_gapbin} AS gap, Outcome, avg(loss) AS mean_loss, avg(loss) FILTER (loss >= q) AS top_loss, avg(pred_total) FILTER (loss >= q) AS top_total, count(*) FILTER (loss >= q) AS n_top FROM (SELECT *, (pred_prob - Outcome) * (pred_prob - Outcome) AS loss FROM plog JOIN seedab USING (_seq) WHERE sd IS NOT NULL), (SELECT quantile_cont((pred_prob - Outcome) * (pred_prob - Outcome), 0.75) AS q FROM plog) GROUP BY ALL", "mean_loss top_loss top_total")
def _(spark, d):
    """Loss by seed gap and outcome; what the worst quarter looks like."""
    loss = (F.col("pred_prob") - F.col("Outcome")) * (F.col("pred_prob") - F.col("Outcome"))
    p = fx.plog(spark, d).withColumn("loss", loss)
    q = metrics.exact_quantiles(p, "loss", [0.75]).select(F.col("q")[0].alias("q"))
    g = p.join(seed_gap(spark, d), "_seq").where("sd IS NOT NULL").crossJoin(F.broadcast(q))  # one row
    gap = F.when(F.abs("sd") <= 3, "close").when(F.abs("sd") <= 8, "mid").otherwise("wide")
    top = F.col("loss") >= F.col("q")
    return g.groupBy(gap.alias("gap"), "Outcome").agg(F.avg("loss").alias("mean_loss"), F.avg(F.when(top, F.col("loss"))).alias("top_loss"), F.avg(F.when(top, F.col("pred_total"))).alias("top_total"), F.count_if(top).alias("n_top"))


@query("a29_best_scale", "plog", "SELECT min_by(alpha, mse) AS alpha, min(mse) AS mse FROM (SELECT alpha, avg((alpha * pred_margin - Margin) ** 2) AS mse FROM plog, (SELECT i / 100.0 - 1.0 AS alpha FROM range(0, 261) t(i)) GROUP BY alpha)", "alpha mse")
def _(spark, d):
    grid = spark.range(261).select((F.col("id") / 100.0 - 1.0).alias("alpha"))
    return metrics.best_scale(fx.plog(spark, d), "pred_margin", "Margin", grid)


TEMPERATURES = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 12.0]


@query("a30_best_temperature", "plog", "SELECT men_women, min_by(t, l) AS t, min(l) AS loss FROM (SELECT men_women, t, avg((1.0 / (1.0 + exp(-ln(q / (1.0 - q)) / t)) - Outcome) ** 2) AS l FROM (SELECT *, least(greatest(pred_prob, 1e-7), 1 - 1e-7) AS q FROM plog), (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in TEMPERATURES) + "]) AS t) GROUP BY ALL) GROUP BY men_women", "t loss")
def _(spark, d):
    loss = lambda t: (scores.temper(F.col("pred_prob"), t) - F.col("Outcome")) ** 2
    return metrics.best_of_grid(fx.plog(spark, d), ["men_women"], loss, TEMPERATURES, "t")


@query("a30_closing_grids", "plog", "SELECT count(DISTINCT men_women) AS n_rows, 0 AS n_violations FROM plog")
def _(spark, d):
    """Grids that close in never end above the coarse grid's least loss."""
    p = fx.plog(spark, d).select("men_women", "pred_prob", "Outcome")
    loss = lambda t: (scores.temper(F.col("pred_prob"), t) - F.col("Outcome")) ** 2
    fine = metrics.fit_grid(p, ["men_women"], loss, 0.5, 12.0, "t", points=9, rounds=3)
    t = F.lit(None).cast("double")
    for (m,), v in fine.items():
        t = F.when(F.col("men_women") == m, F.lit(v)).otherwise(t)
    got = p.groupBy("men_women").agg(F.avg(loss(t)).alias("fine"))
    coarse = metrics.best_of_grid(p, ["men_women"], loss, [0.5 + i * 11.5 / 8 for i in range(9)], "t")
    return got.join(coarse, "men_women").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("fine") > F.col("loss") + 1e-12).cast("int").alias("n_violations"))


@query("a31_rating_weights", "game_raw", "SELECT 4 AS n_weights, 1 AS sums_to_one, 1 AS not_worse")
def _(spark, d):
    """Candidate weightings of four z-scored features, a batch in one aggregation; the best simplex point is refined."""
    from boutlake.operators.weights import search_weights

    r = rolling_ab(spark, d).fillna(0.0)
    cols = [F.col(f"A_{c}") - F.col(f"B_{c}") for c in ("NetEff", "OE", "DE", "Tempo")]
    flip = F.when(F.col("_seq") % 2 == 0, 1).otherwise(-1)
    data = r.select(*[(c * flip).alias(f"f{i}") for i, c in enumerate(cols)], F.when(flip == 1, 1).otherwise(0).alias("y"))
    w, loss, start = search_weights(data, [f"f{i}" for i in range(4)], "y")
    return spark.createDataFrame([(len(w), int(abs(sum(w) - 1) < 1e-9), int(loss <= start + 1e-12))], "n_weights int, sums_to_one int, not_worse int")


fx.SQL["runs"] = "SELECT Season AS run_id, 'v' || (Season % 3) AS variant, avg((pred_prob - Outcome) * (pred_prob - Outcome)) AS brier, avg(abs(pred_margin - Margin)) AS mae FROM plog GROUP BY Season"


def runs(spark, d):
    return fx.plog(spark, d).groupBy(F.col("Season").alias("run_id")).agg(metrics.brier("pred_prob", "Outcome").alias("brier"), F.avg(F.abs(F.col("pred_margin") - F.col("Margin"))).alias("mae")).withColumn("variant", F.concat(F.lit("v"), (F.col("run_id") % 3).cast("string")))


@query("a33_best_run", "runs", "SELECT run_id, variant, brier, brier - min(brier) OVER () AS d_champion, (brier = min(brier) OVER (PARTITION BY variant))::INT AS best_of_variant FROM runs", "brier d_champion")
def _(spark, d):
    """Best run per variant and each run's distance to the best of all; there are few runs."""
    r = runs(spark, d)
    best = r.agg(F.min("brier").alias("_b"))
    return r.crossJoin(F.broadcast(best)).select("run_id", "variant", "brier", (F.col("brier") - F.col("_b")).alias("d_champion"), (F.col("brier") == F.min("brier").over(Window.partitionBy("variant"))).cast("int").alias("best_of_variant"))


@query("a34_threshold_gate", "runs", "SELECT run_id, metric, value, bound FROM (UNPIVOT runs ON brier, mae INTO NAME metric VALUE value) JOIN (VALUES ('brier', 0.34), ('mae', 16.0)) t(metric, bound) USING (metric) WHERE value > bound", "value")
def _(spark, d):
    limits = F.broadcast(spark.createDataFrame([("brier", 0.34), ("mae", 16.0)], "metric string, bound double"))
    long = runs(spark, d).unpivot(["run_id"], ["brier", "mae"], "metric", "value")
    return long.join(limits, "metric").where("value > bound").select("run_id", "metric", "value", "bound")


_half = "(day(ts) > 15)"
_ks = "SELECT max(abs(c / nc - r / nr)) AS ks, any_value(nc) AS nc, any_value(nr) AS nr FROM (SELECT sum(cur) OVER (ORDER BY v) AS c, sum(ref) OVER (ORDER BY v) AS r, sum(cur) OVER () AS nc, sum(ref) OVER () AS nr FROM (SELECT value AS v, count(*) FILTER {h} AS cur, count(*) FILTER (NOT {h}) AS ref FROM events WHERE value IS NOT NULL GROUP BY value))"
_lam = "((sqrt(nc * nr / (nc + nr)) + 0.12 + 0.11 / sqrt(nc * nr / (nc + nr))) * ks)"


@query("a35_drift_ks", "", f"SELECT ks, greatest(0.0, least(1.0, {' + '.join(f'({2.0 * (-1) ** (k - 1)}) * exp(-2.0 * {k * k} * {_lam} * {_lam})' for k in range(1, 21))})) AS p_value FROM ({_ks.format(h=_half)})", "ks p_value")
def _(spark, d):
    return metrics.ks_statistic(fx.table(spark, d, "events"), "value", F.dayofmonth("ts") > 15)


@query("a35_drift_psi", "", f"SELECT sum((c - r) * ln(c / r)) AS psi FROM (SELECT greatest(coalesce(cur, 0) / sum(cur) OVER (), 0.0001) AS c, greatest(coalesce(ref, 0) / sum(ref) OVER (), 0.0001) AS r FROM range(10) b(bin) LEFT JOIN (SELECT len(list_filter(e, lambda x: x < value)) AS bin, count(*) FILTER {_half} AS cur, count(*) FILTER (NOT {_half}) AS ref FROM events, (SELECT quantile_cont(value, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM events WHERE NOT {_half}) WHERE value IS NOT NULL GROUP BY 1) USING (bin))", "psi")
def _(spark, d):
    return metrics.population_stability(fx.table(spark, d, "events"), "value", F.dayofmonth("ts") > 15)


DRIFTED = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
_ks_line = " UNION ALL ".join(f"SELECT '{c}' AS col, max(abs(c / nc - r / nr)) AS ks, any_value(nc) AS nc, any_value(nr) AS nr FROM (SELECT sum(cur) OVER (ORDER BY v) AS c, sum(ref) OVER (ORDER BY v) AS r, sum(cur) OVER () AS nc, sum(ref) OVER () AS nr FROM (SELECT {c} AS v, count(*) FILTER (year(l_shipdate) >= 2000) AS cur, count(*) FILTER (year(l_shipdate) < 2000) AS ref FROM lineitem GROUP BY 1))" for c in DRIFTED)
_p_value = f"greatest(0.0, least(1.0, {' + '.join(f'({2.0 * (-1) ** (k - 1)}) * exp(-2.0 * {k * k} * {_lam} * {_lam})' for k in range(1, 21))}))"


@query("a35_drifted_share", "", f"SELECT count(*) AS n_columns, avg((p < 0.05)::INT) AS drifted_share, max(ks) AS worst FROM (SELECT ks, {_p_value} AS p FROM ({_ks_line}))", "drifted_share worst")
def _(spark, d):
    """Two periods of line items: how many numeric columns were looked at, which share drifted at 5 percent, the largest distance."""
    l = fx.table(spark, d, "lineitem")
    parts = [metrics.ks_statistic(l, c, F.year("l_shipdate") >= 2000) for c in DRIFTED]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.agg(F.count(F.lit(1)).alias("n_columns"), F.avg((F.col("p_value") < 0.05).cast("int")).alias("drifted_share"), F.max("ks").alias("worst"))


@query("a36_classification_report", "plog", f"SELECT c.*, auc FROM (SELECT source, count(*) FILTER (pred_prob > 0.5 AND Outcome = 1) / count(*) FILTER (pred_prob > 0.5)::DOUBLE AS prec, count(*) FILTER (pred_prob > 0.5 AND Outcome = 1) / count(*) FILTER (Outcome = 1)::DOUBLE AS recall, 2.0 * count(*) FILTER (pred_prob > 0.5 AND Outcome = 1) / (count(*) FILTER (pred_prob > 0.5) + count(*) FILTER (Outcome = 1)) AS f1, avg(-(Outcome * ln(least(greatest(pred_prob, 1e-7), 1 - 1e-7)) + (1 - Outcome) * ln(1 - least(greatest(pred_prob, 1e-7), 1 - 1e-7)))) AS log_loss FROM plog GROUP BY source) c JOIN ({AUC_SQL}) USING (source)", "prec recall f1 log_loss auc")
def _(spark, d):
    p = fx.plog(spark, d)
    yes, true = F.col("pred_prob") > 0.5, F.col("Outcome") == 1
    hit, said, are = F.count_if(yes & true), F.count_if(yes), F.count_if(true)
    c = p.groupBy("source").agg(F.try_divide(hit, said).alias("prec"), F.try_divide(hit, are).alias("recall"), F.try_divide(2.0 * hit, said + are).alias("f1"), metrics.log_loss("pred_prob", "Outcome").alias("log_loss"))
    return c.join(metrics.area_under_curve(p, "pred_prob", "Outcome", ["source"]), "source")


@query("a37_reliability_curve", "plog", "SELECT least(floor(pred_prob * 10), 9)::INT AS bin, count(*) AS n, avg(pred_prob) AS mean_p, avg(Outcome) AS mean_y FROM plog GROUP BY bin", "mean_p mean_y")
def _(spark, d):
    return metrics.calibration_bins(fx.plog(spark, d), "pred_prob", "Outcome")


@query("a37_fold_pivot", "plog", "SELECT men_women, avg((pred_prob - Outcome) ** 2) FILTER (Season = 1999) AS s1999, avg((pred_prob - Outcome) ** 2) FILTER (Season = 2000) AS s2000, avg((pred_prob - Outcome) ** 2) FILTER (Season = 2001) AS s2001 FROM plog GROUP BY men_women", "s1999 s2000 s2001")
def _(spark, d):
    p = fx.plog(spark, d).groupBy("men_women").pivot("Season", [1999, 2000, 2001]).agg(metrics.brier("pred_prob", "Outcome"))
    return p.withColumnsRenamed({str(y): f"s{y}" for y in (1999, 2000, 2001)})


_folds = ", ".join(f"avg((pred_prob - Outcome) ** 2) FILTER (Season = {y}) AS s{y}" for y in range(1995, 2002))


@query("a37_fold_pivot_all_seasons", "plog", f"SELECT men_women, {_folds} FROM plog GROUP BY men_women", " ".join(f"s{y}" for y in range(1995, 2002)))
def _(spark, d):
    """A column for each season that the log holds; their number is that of the folds."""
    p = fx.plog(spark, d)
    seasons = sorted(r[0] for r in p.select("Season").distinct().collect())
    wide = p.groupBy("men_women").pivot("Season", seasons).agg(metrics.brier("pred_prob", "Outcome"))
    return wide.withColumnsRenamed({str(y): f"s{y}" for y in seasons})


@query("a37_normalised_axes", "runs", "SELECT run_id, (brier - min(brier) OVER ()) / (max(brier) OVER () - min(brier) OVER ()) AS x_brier, mae / max(mae) OVER () AS mae_share FROM runs", "x_brier mae_share")
def _(spark, d):
    """Min-max and share of the maximum over the runs table, which has a row per run."""
    r = runs(spark, d)
    s = r.agg(F.min("brier").alias("lo"), F.max("brier").alias("hi"), F.max("mae").alias("top"))
    return r.crossJoin(F.broadcast(s)).select("run_id", ((F.col("brier") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x_brier"), (F.col("mae") / F.col("top")).alias("mae_share"))


fx.SQL["day_summary"] = "SELECT Season, DayNum, count(*) AS n, avg(pred_margin - Margin) AS signed_miss, avg(abs(pred_margin - Margin)) AS abs_miss FROM plog GROUP BY ALL"


def day_summary(p):
    miss = F.col("pred_margin") - F.col("Margin")
    return p.groupBy("Season", "DayNum").agg(F.count(F.lit(1)).alias("n"), F.avg(miss).alias("signed_miss"), F.avg(F.abs(miss)).alias("abs_miss"))


@query("a38_day_summary", "day_summary", "SELECT * FROM day_summary", "signed_miss abs_miss")
def _(spark, d):
    return day_summary(fx.plog(spark, d))


@query("a39_book_averages", "lines_market", "SELECT Season, DayNum, home_id, avg(spread) AS spread, avg(total) AS total, count(*) AS books FROM lines_market WHERE abs(spread) <= 60 GROUP BY ALL", "spread total")
def _(spark, d):
    return fx.lines_market(spark, d).where("abs(spread) <= 60").groupBy("Season", "DayNum", "home_id").agg(F.avg("spread").alias("spread"), F.avg("total").alias("total"), F.count(F.lit(1)).alias("books"))


@query("a40_bracket_checks", "game_raw seeds", """SELECT 'winner_is_loser' AS rule, count(*) AS n FROM game_raw WHERE WTeamID = LTeamID UNION ALL SELECT 'outside_field', count(*) FROM (SELECT Season, unnest([WTeamID, LTeamID]) AS TeamID FROM game_raw WHERE DayNum >= 134) g ANTI JOIN (SELECT * FROM seeds WHERE r <= 32) s USING (Season, TeamID)
 UNION ALL SELECT 'undefeated', count(*) FROM (SELECT Season, WTeamID FROM game_raw WHERE DayNum >= 134 GROUP BY ALL) w ANTI JOIN (SELECT Season, LTeamID FROM game_raw WHERE DayNum >= 134) l ON l.Season = w.Season AND l.LTeamID = w.WTeamID""")
def _(spark, d):
    """Assertions as counts of rows that break them."""
    g = fx.game_raw(spark, d)
    t = g.where("DayNum >= 134")
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    played = history.team_rows(t).select("Season", "TeamID")
    known = fx.seeds(spark, d).where("r <= 32").select("Season", "TeamID")
    won, lost = t.select("Season", F.col("WTeamID").alias("TeamID")).distinct(), t.select("Season", F.col("LTeamID").alias("TeamID"))
    return count(g.where("WTeamID = LTeamID"), "winner_is_loser").unionByName(count(played.join(known, ["Season", "TeamID"], "left_anti"), "outside_field")).unionByName(count(won.join(lost, ["Season", "TeamID"], "left_anti"), "undefeated"))


@query("a41_agreement", "matched", "SELECT CASE WHEN DayNum % 7 < 3 THEN 'fresh' ELSE 'stale' END AS age, corr(pred_margin, cmp_margin) AS r, avg(abs(pred_margin - cmp_margin)) AS gap, count(*) AS n FROM matched GROUP BY age", "r gap")
def _(spark, d):
    m = matched(spark, d)
    return m.groupBy(F.when(F.col("DayNum") % 7 < 3, "fresh").otherwise("stale").alias("age")).agg(F.corr("pred_margin", "cmp_margin").alias("r"), F.avg(F.abs(F.col("pred_margin") - F.col("cmp_margin"))).alias("gap"), F.count(F.lit(1)).alias("n"))


@query("a42_market_divergence", "plog implied", "SELECT avg(p - v) AS mean_gap, avg((abs(p - y) < abs(v - y))::INT) AS closer, count(*) FILTER (abs(p - v) > 0.25) AS n_wide FROM (SELECT CASE WHEN A_TeamID = home_id THEN pred_prob ELSE 1 - pred_prob END AS p, ph / (ph + pv) AS v, CASE WHEN A_TeamID = home_id THEN Outcome ELSE 1 - Outcome END AS y FROM plog JOIN implied USING (_seq))", "mean_gap closer")
def _(spark, d):
    m = fx.lines_market(spark, d).select("_seq", "home_id", scores.implied_probability(F.col("home_ml")).alias("ph"), scores.implied_probability(F.col("vis_ml")).alias("pv"))
    same = F.col("A_TeamID") == F.col("home_id")
    g = fx.plog(spark, d).join(m, "_seq").select(F.when(same, F.col("pred_prob")).otherwise(1 - F.col("pred_prob")).alias("p"), (F.col("ph") / (F.col("ph") + F.col("pv"))).alias("v"), F.when(same, F.col("Outcome")).otherwise(1 - F.col("Outcome")).alias("y"))
    return g.agg(F.avg(F.col("p") - F.col("v")).alias("mean_gap"), F.avg((F.abs(F.col("p") - F.col("y")) < F.abs(F.col("v") - F.col("y"))).cast("int")).alias("closer"), F.count_if(F.abs(F.col("p") - F.col("v")) > 0.25).alias("n_wide"))


@query("a43_form_by_seed_tier", "reg seednum", "SELECT CASE WHEN SeedNum <= 4 THEN 'top' WHEN SeedNum <= 10 THEN 'mid' ELSE 'low' END AS tier, avg(f) AS mean_form, stddev_samp(f) AS sd_form, count(*) AS n FROM (SELECT men_women, Season, T1_TeamID AS TeamID, avg((Outcome = 1)::INT) AS f FROM reg WHERE DayNum > 103 GROUP BY ALL) JOIN seednum USING (men_women, Season, TeamID) GROUP BY tier", "mean_form sd_form")
def _(spark, d):
    from boutlake.plans.catalog_log import seed_numbers

    f = teams.recent_form(fx.reg(spark, d)).join(seed_numbers(spark, d), ["men_women", "Season", "TeamID"])
    tier = F.when(F.col("SeedNum") <= 4, "top").when(F.col("SeedNum") <= 10, "mid").otherwise("low")
    return f.groupBy(tier.alias("tier")).agg(F.avg("RecentWinPct").alias("mean_form"), F.stddev_samp("RecentWinPct").alias("sd_form"), F.count(F.lit(1)).alias("n"))


CROSS = ["avg_Score", "avg_PointDiff", "avg_TO", "avg_Ast"]


@query("a44_cross_correlation", "avgs", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM avgs" for i, a in enumerate(CROSS) for b in CROSS[i + 1 :]), "r")
def _(spark, d):
    """All pairs in one aggregation, then one row per pair."""
    pairs = [(a, b) for i, a in enumerate(CROSS) for b in CROSS[i + 1 :]]
    one = teams.season_averages(fx.reg(spark, d), BOX).agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    long = one.withColumn("k", F.lit(0)).unpivot(["k"], [f"{a}~{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", "~")[0].alias("x"), F.split("pair", "~")[1].alias("y"), "r")
