"""Team-season features from the symmetric log."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlake.functions.scores import FORM_DAY, FT, HOME_EDGE, floor_at, game_possessions, rank_share
from boutlake.operators import blocks
from boutlake.tables import Turns, pinned

KEYS = ["men_women", "Season"]


def season_averages(log: DataFrame, box: tuple[str, ...]) -> DataFrame:
    """Means of own and allowed box statistics per team-season: one aggregation, so one shuffle of partial sums.

    Sums are of decimals (nine places) and so exact: a mean doesn't depend on the order of the rows.
    """
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,9)")).cast("double") / F.count(c)
    aggs = [mean(f"T1_{c}").alias(f"avg_{c}") for c in box] + [mean("PointDiff").alias("avg_PointDiff")] + [mean(f"T2_{c}").alias(f"avg_opp_{c}") for c in box]
    return log.groupBy(*KEYS, F.col("T1_TeamID").alias("TeamID")).agg(*aggs)


def four_factor_columns() -> dict[str, Column]:
    """The 32 rate columns over season averages; denominators below 1 count as 1 and missing stays missing."""
    own = lambda c: F.col(f"avg_{c}")
    opp = lambda c: F.col(f"avg_opp_{c}")
    per = lambda x, y: x / floor_at(y, 1)
    poss = {s: f("FGA") - f("OR") + f("TO") + FT * f("FTA") for s, f in (("", own), ("opp_", opp))}
    out = {f"{s}poss": p for s, p in poss.items()}
    for s, a, b in (("", own, opp), ("opp_", opp, own)):
        two, two_tried = a("FGM") - a("FGM3"), a("FGA") - a("FGA3")
        out |= {
            f"{s}eFGpct": per(a("FGM") + 0.5 * a("FGM3"), a("FGA")),
            f"{s}TOpct": per(a("TO"), poss[s]),
            f"{s}ORpct": per(a("OR"), a("OR") + b("DR")),
            f"{s}FTrate": per(a("FTA"), a("FGA")),
            f"{s}TSpct": per(a("Score"), 2 * (a("FGA") + FT * a("FTA"))),
            f"{s}FG3pct": per(a("FGM3"), a("FGA3")),
            f"{s}FG2pct": per(two, two_tried),
            f"{s}FTpct": per(a("FTM"), a("FTA")),
            f"{s}3PArate": per(a("FGA3"), a("FGA")),
            f"{s}ASTrate": per(a("Ast"), a("FGM")),
            f"{s}NonStlTOpct": per(floor_at(a("TO") - b("Stl"), 0), poss[s]),
            f"{s}pct_pts_3": per(3 * a("FGM3"), a("Score")),
            f"{s}pct_pts_2": per(2 * two, a("Score")),
            f"{s}pct_pts_ft": per(a("FTM"), a("Score")),
        }
    out["Blkpct"] = per(own("Blk"), opp("FGA") - opp("FGA3"))
    out["Stlpct"] = per(own("Stl"), poss["opp_"])
    return out


def add_four_factors(avgs: DataFrame) -> DataFrame:
    return avgs.select("*", *[c.alias(n) for n, c in four_factor_columns().items()])


def recent_form(log: DataFrame, after_day: int = FORM_DAY) -> DataFrame:
    late = log.where(F.col("DayNum") > after_day)
    return late.groupBy(*KEYS, F.col("T1_TeamID").alias("TeamID")).agg(F.avg((F.col("Outcome") == 1).cast("int")).alias("RecentWinPct"), F.count(F.lit(1)).alias("RecentGames"))


def efficiency_games(log: DataFrame, edge: float = HOME_EDGE) -> DataFrame:
    """Per game and side: points scored and allowed per 100 possessions without the home edge, and pace."""
    poss = game_possessions()
    return log.select(
        *KEYS, "DayNum", F.col("T1_TeamID").alias("t"), F.col("T2_TeamID").alias("o"), poss.alias("poss"),
        (100.0 * F.col("T1_Score") / poss - F.col("T1_home") * edge).alias("oe"), (100.0 * F.col("T2_Score") / poss + F.col("T1_home") * edge).alias("de"),
    )


def _efficiency_start(games: DataFrame, keys: list[str]) -> DataFrame:
    first = games.groupBy(*keys, "t").agg(F.avg("oe").alias("AdjOE"), F.avg("de").alias("AdjDE"), F.avg("poss").alias("tempo"))
    lg = Window.partitionBy(*keys)
    return first.withColumns({"lg": F.avg("AdjOE").over(lg), "lg_tempo": F.avg("tempo").over(lg), "change": F.lit(float("inf")), "iters": F.lit(0)})


def _efficiency_edges(games: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """The games with their league's mean, and a row of each team with itself: through it a round's one join also brings a team its own last rating."""
    met = games.select(*keys, "t", "o", "oe", "de").join(first.select(*keys, "t", "lg"), [*keys, "t"])
    itself = first.select(*keys, "t", F.col("t").alias("o"), F.lit(None).cast("double").alias("oe"), F.lit(None).cast("double").alias("de"), "lg")
    return met.withColumn("own", F.lit(False)).unionByName(itself.withColumn("own", F.lit(True)))


def _efficiency_round(edges: DataFrame, at: DataFrame, keys: list[str], tol: float | None = None) -> DataFrame:
    """One round: each game against the opponent's rating, the mean brought back to the league's. Groups whose last change is below ``tol`` stay as they are.

    ``at`` is read once, so the plan of several rounds grows with their number only.
    """
    opp = at.select(*keys, F.col("t").alias("o"), "AdjOE", "AdjDE", "change", "iters")
    own = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    against = lambda c, r: F.avg(F.col(c) / floor_at(F.coalesce(r, "lg"), 1) * F.col("lg"))
    new = edges.join(opp, [*keys, "o"], "left").groupBy(*keys, "t").agg(against("oe", "AdjDE").alias("n_oe"), against("de", "AdjOE").alias("n_de"), *map(own, ("AdjOE", "AdjDE", "change", "iters")), F.max("lg").alias("lg"))
    w = Window.partitionBy(*keys)
    scaled = new.withColumns({c: F.col(c) * F.col("lg") / floor_at(F.avg(c).over(w), 1) for c in ("n_oe", "n_de")})
    moved = F.greatest(F.abs(F.col("n_oe") - F.col("AdjOE")), F.abs(F.col("n_de") - F.col("AdjDE")))
    on = F.lit(True) if tol is None else F.col("change") >= tol
    step = {"AdjOE": F.col("n_oe"), "AdjDE": F.col("n_de"), "change": F.max(moved).over(w), "iters": F.col("iters") + 1}
    return scaled.select(*keys, "t", *[F.when(on, new).otherwise(F.col(c)).alias(c) for c, new in step.items()])


def adjusted_efficiency(log: DataFrame, rounds: int | None = None, max_rounds: int = 50, tol: float = 1e-4, edge: float = HOME_EDGE, extra_keys: tuple[str, ...] = (), games: DataFrame | None = None, block: int = 500_000) -> DataFrame:
    """Opponent-adjusted efficiency as a fixed point, in blocks of about ``block`` pairs of a team and an opponent.

    With ``rounds`` there are just that many rounds. Without, rounds go on until
    every group's largest change is below ``tol``, ``max_rounds`` at most; a group that
    got there is set aside. Blocks are dealt once; a round shuffles the ratings that blocks need of each other and writes them
    once to the shared folder, in place of those of the last round but one. The driver sees sums, counts and the largest change of each group, a row per group.
    How far a round moved is known in the next one, so a settled group makes one round more, which doesn't count.
    """
    keys = [*KEYS, *extra_keys]
    g = pinned(efficiency_games(log, edge)) if games is None else games
    team = g.schema["t"].dataType
    packed, known, groups = blocks.pack(g, keys, block)
    packed = packed.repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b").persist()  # as every round joins it: dealt once
    turns = Turns(log.sparkSession)
    try:
        mean = blocks.means(packed)
        tempo = packed.withColumns({f"{x}{c}{y}": F.col(f"{x}poss{y}") for c in ("oe", "de") for x, y in (("", ""), ("n_", ""), ("", "0"))})
        tempo = pinned(blocks.sent_next(tempo, blocks.sent_first(tempo), {i: (mean[i][1], 1.0, 1.0) for i in range(groups)}).where(F.col("src") == blocks.OWN).select("b", F.col("oe").alias("AdjTempo")))
        sent = turns.pinned(blocks.sent_first(packed))
        by, parts, k, limit = {i: (mean[i][0], 1.0, 1.0) for i in range(groups)}, [], 0, max_rounds if rounds is None else rounds
        while by and k < limit:
            sent = turns.pinned(blocks.sent_next(packed, sent, by))
            told = sent.where(F.col("src") == blocks.OWN).groupBy("gid").agg(*[F.sum(c).alias(c) for c in ("s_oe", "c_oe", "s_de", "c_de")], F.max("change").alias("change")).collect()
            settled = [r.gid for r in told if rounds is None and k and (r.change is None or r.change < tol)]
            if settled:
                parts.append(pinned(sent.where(F.col("gid").isin(settled) & (F.col("src") == blocks.OWN)).select("gid", "b", "src", F.col("x_oe").alias("AdjOE"), F.col("x_de").alias("AdjDE"), F.lit(k).alias("iters"))))  # of its own, as a later round takes the folder
            scale = lambda lg, s, n: lg / max(1.0, s / n) if n and s == s else float("nan") if n else 1.0
            by = {r.gid: (lg := by[r.gid][0], scale(lg, r.s_oe, r.c_oe), scale(lg, r.s_de, r.c_de)) for r in told if r.gid not in settled}
            k += 1
    finally:
        packed.unpersist()
    last = F.broadcast(log.sparkSession.createDataFrame([(i, x[1], x[2]) for i, x in by.items()], "gid int, f_oe double, f_de double"))  # a row per group
    scaled = lambda c: F.transform(c, lambda x: x * F.col(f"f_{c}"))
    parts.append(sent.join(last, "gid").select("gid", "b", "src", scaled("oe").alias("AdjOE"), scaled("de").alias("AdjDE"), F.lit(k).alias("iters")))
    done = reduce(DataFrame.unionByName, parts).where(F.col("src") == blocks.OWN).join(known, "b").join(tempo, "b")
    out = done.select(*keys, "iters", F.explode(F.arrays_zip("team", "AdjOE", "AdjDE", "AdjTempo")).alias("r"))
    return out.select(*keys, F.col("r.team").cast(team).alias("TeamID"), "r.AdjOE", "r.AdjDE", (F.col("r.AdjOE") - F.col("r.AdjDE")).alias("AdjEM"), "r.AdjTempo", "iters")


def efficiency_snapshots(log: DataFrame, calendar: DataFrame, cuts: list[int], rounds: int | None = None, only: dict[int, list[int]] | None = None) -> DataFrame:
    """As-of efficiency for every cut day: one run with the cut as a further group key, over games strictly before it. ``only`` names the cuts of each season where these differ; other seasons have none."""
    mine = F.array(*map(F.lit, cuts))
    if only is not None:
        mine = F.array().cast("array<int>")
        for season, own in only.items():
            mine = F.when(F.col("Season") == season, F.array(*map(F.lit, own)).cast("array<int>")).otherwise(mine)
    games = pinned(efficiency_games(log))
    games = games.withColumn("cut", F.explode(F.filter(mine, lambda c: c > F.col("DayNum"))))
    adj = adjusted_efficiency(log, rounds=rounds, extra_keys=("cut",), games=games)
    dated = adj.join(F.broadcast(calendar.select("Season", "DayZero")), "Season")  # one row per season
    return dated.select("Season", "TeamID", F.date_add("DayZero", F.col("cut")).alias("ArchiveDate"), *[F.col(c).alias(f"adjself_{c}_asof") for c in ("AdjOE", "AdjDE", "AdjEM", "AdjTempo")])


def quality_weighted_margin(log: DataFrame, ratings: DataFrame) -> DataFrame:
    """Margins weighted by the opponent's average percent rank in AdjEM; an unknown opponent weighs 0.5."""
    share = ratings.select(*KEYS, F.col("TeamID").alias("T2_TeamID"), rank_share("AdjEM", ["Season", "men_women"]).alias("w"))
    w = F.coalesce(F.col("w"), F.lit(0.5))
    return log.join(share, [*KEYS, "T2_TeamID"], "left").groupBy(*KEYS, F.col("T1_TeamID").alias("TeamID")).agg((F.sum(w * F.col("PointDiff")) / (F.sum(w) + 1e-9)).alias("quality_wtd_margin"))


def consensus_rank(ordinals: DataFrame, systems: tuple[str, ...] = ("POM", "MOR"), last_day: int = 133) -> DataFrame:
    """Mean over systems of the z-score of each team's last rank by ``last_day`` (higher is better)."""
    kept = ordinals.where(F.col("SystemName").isin(*systems) & (F.col("RankingDayNum") <= last_day) & F.col("OrdinalRank").isNotNull())
    last = kept.groupBy("Season", "SystemName", "TeamID").agg((-F.max_by("OrdinalRank", "RankingDayNum")).alias("x"))
    w = Window.partitionBy("Season", "SystemName")
    z = F.try_divide(F.col("x") - F.avg("x").over(w), F.stddev_pop("x").over(w))
    return last.select("Season", "TeamID", z.alias("z")).groupBy("Season", "TeamID").agg(F.avg("z").alias("MasseyRank"))


def laplacian(log: DataFrame) -> DataFrame:
    """Per pair: number of rows and sum of margins. What least squares needs of the log, aggregated before any group is formed."""
    return log.groupBy(*KEYS, "T1_TeamID", "T2_TeamID").agg(F.count(F.lit(1)).alias("n"), F.sum("PointDiff").alias("m"))


def _products(vectors: DataFrame, m: int) -> dict[tuple, np.ndarray]:
    """Per season and pool, the inner products of all of a team's numbers: ``m`` vectors w, their images lw, and r. Tasks send a matrix a season, added up by Spark."""
    width = 2 * m + 1

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            rows = np.column_stack([*(b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) for c in (2, 3)), b.column(4).to_numpy(zero_copy_only=False)])
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1)
            names, at = np.unique(keys, axis=0, return_inverse=True)
            for k, name in enumerate(names.tolist()):
                own = rows[at.ravel() == k]
                held[tuple(name)] = held.get(tuple(name), 0.0) + own.T @ own
        for name, p in held.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * width * width, pa.int32()) for k in name], pa.array(range(width * width), pa.int32()), pa.array(p.ravel())], names=[*KEYS, "at", "p"])

    schema = ", ".join(f"{k} int" for k in KEYS) + ", at int, p double"
    parts = vectors.select(*KEYS, "w", "lw", "r").mapInArrow(run, schema).groupBy(*KEYS, "at").agg(F.sum("p").alias("p"))
    out: dict[tuple, np.ndarray] = {}
    for r in parts.collect():  # a matrix of fixed size per season and pool
        out.setdefault(tuple(r[k] for k in KEYS), np.zeros((width, width)))[divmod(r["at"], width)] = r.p
    return out


def least_squares_quality(log: DataFrame, tol: float = 1e-10, most_rounds: int = 60, steps: int = 6) -> DataFrame:
    """Minimum-norm least-squares team quality: (KEYS, TeamID, Quality, residual); coefficients sum to 0 in each connected component.

    Conjugate gradients in blocks on the normal equations of all seasons at once. A round
    makes the next ``steps`` vectors of every season's Krylov space (a Chebyshev basis, so
    that they stay apart), each a join of the folded pairs with a row per team and one
    aggregation, all in one plan that is written once. One aggregation then gives each season's
    small matrix of inner products; the driver solves these (a row per season and pool) and the
    best combination, with the last round's direction among the vectors, moves the solution.
    From 0 it stays in the range of the matrix, which makes it the one of least norm. Seasons
    whose residual is below ``tol`` of its start are set aside; ``residual`` is that share. One
    that isn't after ``most_rounds`` raises. Rows without a margin don't count.
    """
    spark = log.sparkSession
    side = lambda t, o, m: F.struct(F.col(t).alias("t"), F.col(o).alias("o"), m.alias("m"))
    both = F.explode(F.array(side("T1_TeamID", "T2_TeamID", F.col("PointDiff")), side("T2_TeamID", "T1_TeamID", -F.col("PointDiff")))).alias("r")
    folded = pinned(log.where(F.col("PointDiff").isNotNull()).select(*KEYS, both).select(*KEYS, "r.*").groupBy(*KEYS, "t", "o").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("m").cast("double").alias("m")))
    start = folded.groupBy(*KEYS, "t").agg(F.sum("n").alias("deg"), F.sum("m").alias("r"))
    span = start.groupBy(*KEYS).agg((2 * F.max("deg")).alias("span"))  # no eigenvalue is larger
    zero = F.lit(0.0)
    at = pinned(start.join(span, KEYS).select(*KEYS, "t", "deg", "span", zero.alias("x"), "r", zero.alias("d"), zero.alias("ld")))
    # a row of a team with itself carries what is known of it through each aggregation
    pairs = pinned(folded.select(*KEYS, "t", "o", "n", F.lit(False).alias("own")).unionByName(at.select(*KEYS, "t", F.col("t").alias("o"), zero.alias("n"), F.lit(True).alias("own")))).repartition(*KEYS, "o").sortWithinPartitions(*KEYS, "o").persist()  # as every step joins it: dealt and sorted once
    first: dict[tuple, float] = {}
    parts: list[DataFrame] = []
    turns = Turns(spark)

    try:
        for _ in range(most_rounds):
            now = at.withColumn("h0", F.col("r"))
            for j in range(steps):
                v = F.col(f"h{j}")
                known = ["deg", "span", "x", "r", "d", "ld", *(f"h{i}" for i in range(j + 1))]
                met = pairs.join(now.select(*KEYS, F.col("t").alias("o"), *known), [*KEYS, "o"])
                near = met.groupBy(*KEYS, "t").agg(F.sum(F.col("n") * v).alias("near"), *[F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in known])  # numbers only, so that it stays a hash aggregation
                turned = 2 * (F.col("deg") * v - F.col("near")) / F.col("span") - v
                now = near.withColumn(f"h{j + 1}", turned if j == 0 else 2 * turned - F.col(f"h{j - 1}")).drop("near")
            h = [F.col(f"h{j}") for j in range(steps + 1)]
            image = [F.col("span") / 2 * ((h[1] if j == 0 else (h[j + 1] + h[j - 1]) / 2) + h[j]) for j in range(steps)]
            vectors, images = F.array(*h[:steps], F.col("d")), F.array(*image, F.col("ld"))
            now = turns.pinned(now.select(*KEYS, "t", "deg", "span", "x", "r", vectors.alias("w"), images.alias("lw")))
            size = range(steps + 1)
            sums = _products(now, steps + 1)
            moves = []
            for key, p in sums.items():
                m = steps + 1
                g, hh, wr, lr, rr = p[:m, m : 2 * m], p[m : 2 * m, m : 2 * m], p[:m, -1], p[m : 2 * m, -1], float(p[-1, -1])
                scale = 1 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
                c = scale * (np.linalg.pinv((g + g.T) / 2 * np.outer(scale, scale), rcond=1e-13, hermitian=True) @ (scale * wr))
                whole = first.setdefault(key, rr)
                left = float(np.sqrt(max(0.0, rr - 2 * c @ lr + c @ hh @ c) / whole)) if whole else 0.0
                moves.append((*key, c.tolist(), left))
            step = F.broadcast(spark.createDataFrame(moves, ", ".join(f"{k} int" for k in KEYS) + ", c array<double>, residual double"))  # a row per season and pool
            along = lambda a: sum((F.col(a)[i] * F.col("c")[i] for i in size), zero)  # noqa: B023, E731
            at = now.join(step, KEYS).select(*KEYS, "t", "deg", "span", (F.col("x") + along("w")).alias("x"), (F.col("r") - along("lw")).alias("r"), along("w").alias("d"), along("lw").alias("ld"), "residual")
            if any(left <= tol for *_, left in moves):
                parts.append(pinned(at.where(F.col("residual") <= tol).select(*KEYS, F.col("t").alias("TeamID"), F.col("x").alias("Quality"), "residual")))  # of its own, as a later round takes the folder
            if all(left <= tol for *_, left in moves):
                break
            at = at.where(F.col("residual") > tol).drop("residual")
        else:
            raise ArithmeticError(f"least squares of a season did not come within {tol} of its start in {most_rounds} rounds")
    finally:
        pairs.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else at.select(*KEYS, F.col("t").alias("TeamID"), F.col("x").alias("Quality"), F.lit(0.0).alias("residual"))


def latest_per_column(snaps: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column."""
    return snaps.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns])
