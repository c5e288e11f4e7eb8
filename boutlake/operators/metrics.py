"""Accuracy, calibration and drift as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutlake.tables import pinned


def brier(p: str | Column, y: str | Column) -> Column:
    p, y = (F.col(x) if isinstance(x, str) else x for x in (p, y))
    return F.avg((p - y) * (p - y))


def log_loss(p: str, y: str) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def prediction_scores(prefix: str) -> list[Column]:
    """Margin and total error, Brier score, win accuracy and count of one predictor, for one ``agg``."""
    m, t, p = (F.col(f"{prefix}_{x}") for x in ("margin", "total", "prob"))
    return [
        F.avg(F.abs(m - F.col("Margin"))).alias("margin_mae"),
        F.avg(F.abs(t - F.col("Total"))).alias("total_mae"),
        brier(p, "Outcome").alias("brier"),
        F.avg(((p > 0.5) == (F.col("Outcome") == 1)).cast("int")).alias("win_acc"),
        F.count(F.lit(1)).alias("n"),
    ]


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins [a, b), the last one closed: count, mean probability, mean outcome."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Count-weighted mean gap over bins; the second aggregation works on ``bins`` rows."""
    b = calibration_bins(df, p, y, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def area_under_curve(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """AUC by the rank-sum formula with averaged ranks; rows are folded by score before anything is ordered."""
    folded = df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = folded.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    s = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("rs"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return s.select(*by, F.try_divide(F.col("rs") - F.col("np") * (F.col("np") + 1) / 2.0, F.col("np") * F.col("nn")).alias("auc"))


def best_scale(df: DataFrame, x: str, y: str, grid: DataFrame) -> DataFrame:
    """The alpha of a grid (column alpha) with the least mean squared error of alpha * x against y: three sums, then the grid."""
    s = df.agg(F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n"))
    a = F.col("alpha")
    scored = grid.crossJoin(F.broadcast(s)).select("alpha", ((a * a * F.col("xx") - 2 * a * F.col("xy") + F.col("yy")) / F.col("n")).alias("mse"))  # one row
    return scored.agg(F.min_by("alpha", "mse").alias("alpha"), F.min("mse").alias("mse"))


def best_of_grid(df: DataFrame, by: list[str], loss_of, values: list[float], name: str) -> DataFrame:
    """Per group, the grid value with the least mean loss: all values in one aggregation, no row is multiplied."""
    sums = df.groupBy(*by).agg(*[F.avg(loss_of(F.lit(v))).alias(f"l{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.col(f"l{i}").alias("loss"), F.lit(v).alias(name)) for i, v in enumerate(values)])
    return sums.select(*by, F.array_min(pairs).alias("best")).select(*by, f"best.{name}", "best.loss")


def fit_grid(df: DataFrame, by: list[str], loss_of, low: float, high: float, name: str, points: int = 21, rounds: int = 3) -> dict[tuple, float]:
    """A bounded minimum per group by grids that close in: one aggregation over all groups a round; the driver sees one row per group (segments, a fixed few)."""
    found: dict[tuple, float] = {}
    spans: dict[tuple, tuple[float, float]] = {}
    kinds = T.StructType([*df.select(*by).schema.fields, T.StructField("_low", T.DoubleType()), T.StructField("_step", T.DoubleType())])
    for k in range(rounds):
        if k == 0:
            at = df.withColumns({"_low": F.lit(low), "_step": F.lit((high - low) / (points - 1))})
        else:
            grid = F.broadcast(df.sparkSession.createDataFrame([(*g, lo, (hi - lo) / (points - 1)) for g, (lo, hi) in spans.items()], kinds))  # one row per group
            at = df.alias("d").join(grid.alias("s"), reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], F.lit(True))).select("d.*", "_low", "_step")
        losses = at.groupBy(*by).agg(F.first("_low").alias("_low"), F.first("_step").alias("_step"), *[F.avg(loss_of(F.col("_low") + F.col("_step") * i)).alias(f"_l{i}") for i in range(points)])
        for r in losses.collect():
            g = tuple(r[c] for c in by)
            told = [(r[f"_l{i}"], r["_low"] + r["_step"] * i) for i in range(points) if r[f"_l{i}"] is not None]
            if told:
                found[g] = min(told)[1]
                spans[g] = (max(low, found[g] - r["_step"]), min(high, found[g] + r["_step"]))
        if not spans:
            break
    return found


def bounded_minimum(df: DataFrame, by: list[str], loss_of, weight: str, low: Column, high: Column, points: int = 33, rounds: int = 4) -> DataFrame:
    """(by, at, loss): per group, where between ``low`` and ``high`` (functions of the group) the weighted mean loss is least, by grids that close in.

    A round is one aggregation over all groups at once with one sum for each point of
    the grid, so rows are neither multiplied nor gathered; the next grid spans the best
    point's neighbours. Groups (segments, a fixed few) are all that is ever joined.
    Equal losses go to the smaller value; groups without weight are left out.
    """
    total = F.sum(weight)
    span = df.groupBy(*by).agg(total.alias("_w")).where("_w > 0").withColumns({"_from": low, "_to": high}).drop("_w")
    span = pinned(span.withColumns({"_low": F.col("_from"), "_step": (F.col("_to") - F.col("_from")) / (points - 1)}))
    found = span
    for _ in range(rounds):
        same = reduce(lambda x, c: x & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")), by, F.lit(True))
        at = df.alias("d").join(F.broadcast(found.alias("s")), same).select("d.*", "_from", "_to", "_low", "_step")  # a row per group
        value = [F.col("_low") + F.col("_step") * i for i in range(points)]
        sums = at.groupBy(*by, "_from", "_to", "_low", "_step").agg(*[(F.sum(F.col(weight) * loss_of(v)) / total).alias(f"_l{i}") for i, v in enumerate(value)])
        best = F.array_min(F.array(*[F.struct(F.col(f"_l{i}").alias("loss"), v.alias("at")) for i, v in enumerate(value)]))
        told = sums.select(*by, "_from", "_to", "_step", best.alias("b"))
        lo, hi = F.greatest("_from", F.col("b.at") - F.col("_step")), F.least("_to", F.col("b.at") + F.col("_step"))
        found = pinned(told.select(*by, "_from", "_to", lo.alias("_low"), ((hi - lo) / (points - 1)).alias("_step"), F.col("b.at").alias("at"), F.col("b.loss").alias("loss")))
    return found.select(*by, "at", "loss")


def _by_range(v: DataFrame, sums: dict[str, Column], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows folded by value ``v`` with the named sums, each with its running sum ``to_*`` (itself included), and one row of all sums.

    Ranges come from approximate quantiles, which only balance the work. A range is
    cumulated by itself and the ranges' totals are its offset, so nothing is ordered in one task.
    """
    edges = sorted(set(v.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.01)))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("v"))) if edges else F.lit(0)
    folded = v.groupBy("v").agg(*[c.alias(n) for n, c in sums.items()]).withColumn("b", at)
    totals = folded.groupBy("b").agg(*[F.sum(n).alias(f"all_{n}") for n in sums])
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("b", *[F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0)).alias(f"o_{n}") for n in sums])
    w = Window.partitionBy("b").orderBy("v")
    run = folded.join(F.broadcast(offsets), "b").select("v", *sums, *[(F.sum(n).over(w) + F.col(f"o_{n}")).alias(f"to_{n}") for n in sums])  # one row per range
    return run, totals.agg(*[F.sum(f"all_{n}").alias(f"all_{n}") for n in sums])


def ks_statistic(df: DataFrame, value: str, is_current: Column, buckets: int = 100) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value, exact and cumulated range by range."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), is_current.cast("int").alias("c"))
    run, total = _by_range(v, {"cur": F.sum("c"), "ref": F.sum(1 - F.col("c"))}, buckets)
    nc, nr = F.col("all_cur"), F.col("all_ref")
    gap = F.abs(F.col("to_cur") / nc - F.col("to_ref") / nr)
    d = run.crossJoin(F.broadcast(total)).select(gap.alias("gap"), nc.alias("nc"), nr.alias("nr")).agg(F.max("gap").alias("ks"), F.first("nc").alias("nc"), F.first("nr").alias("nr"))  # one row
    ne = F.sqrt(F.col("nc") * F.col("nr") / (F.col("nc") + F.col("nr")))
    lam = (ne + 0.12 + 0.11 / ne) * F.col("ks")
    p = sum((2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    return d.select("ks", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p_value"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], buckets: int = 100) -> DataFrame:
    """One row with the array ``q`` of exact quantiles, interpolated between neighbours; null without values.

    Values are folded and cumulated range by range, so no task holds all distinct values.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    run, total = _by_range(v, {"n": F.count(F.lit(1))}, buckets)
    place = [F.lit(s) * (F.col("all_n") - 1) for s in shares]
    holds = lambda at: (F.col("to_n") - F.col("n") <= at) & (at < F.col("to_n"))
    ends = [F.max(F.when(holds(f(p)), F.col("v"))).alias(f"{k}{i}") for i, p in enumerate(place) for k, f in (("lo", F.floor), ("hi", F.ceil))]
    found = run.crossJoin(F.broadcast(total)).agg(F.first("all_n").alias("all_n"), *ends)  # one row
    between = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return found.select(F.when(F.col("all_n").isNotNull(), F.array(*between)).alias("q"))


def population_stability(df: DataFrame, value: str, is_current: Column, bins: int = 10, least: float = 1e-4) -> DataFrame:
    """PSI over bins at the reference's quantiles; an empty share counts as ``least``."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), is_current.alias("c"))
    edges = exact_quantiles(v.where(~F.col("c")), "v", [i / bins for i in range(1, bins)]).withColumnRenamed("q", "edges")
    at = F.size(F.filter("edges", lambda e: e < F.col("v")))
    counts = v.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count_if("c").alias("cur"), F.count_if(~F.col("c")).alias("ref"))  # one row of edges
    every = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, "bin", "left").fillna(0)
    w = Window.partitionBy(F.lit(1))  # one row per bin
    shares = every.select(*[F.greatest(F.col(c) / F.sum(c).over(w), F.lit(least)).alias(c) for c in ("cur", "ref")])
    return shares.agg(F.sum((F.col("cur") - F.col("ref")) * F.log(F.col("cur") / F.col("ref"))).alias("psi"))
