"""Column expressions: rates, probabilities, lines, seeds, labels. All of them stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FT = 0.475
HOME_EDGE = 1.4
FIRST_TOURNAMENT_DAY = 134
SELECTION_DAY = 133
FORM_DAY = 103
SPREAD_SIGMA = 11.5
LOGISTIC_WIDTH = 7.0


def floor_at(x: Column, low: float) -> Column:
    """x, but at least ``low``; null stays null."""
    return F.when(x < low, F.lit(float(low))).otherwise(x)


def possessions(fga: Column, orb: Column, to: Column, fta: Column) -> Column:
    return fga - orb + to + FT * fta


def game_possessions(own: str = "T1_", other: str = "T2_") -> Column:
    """Mean of both sides' estimates, at least 40."""
    a, b = (possessions(*[F.col(p + c) for c in ("FGA", "OR", "TO", "FTA")]) for p in (own, other))
    return floor_at((a + b) / 2, 40)


def pool_of(team: Column) -> Column:
    """0 below id 2000, else 1."""
    return F.when(team < 2000, 0).otherwise(1).cast("int")


def home_sign(loc: Column, a_is_winner: bool) -> Column:
    """Venue from the winner's H/A/N code, oriented to side A."""
    s = F.when(loc == "H", 1).when(loc == "A", -1).otherwise(0).cast("int")
    return s if a_is_winner else -s


def season_of(date: Column) -> Column:
    return (F.year(date) + (F.month(date) >= 8).cast("int")).cast("int")


def parse_seed(seed: Column) -> Column:
    """The digits among the second and third characters; null where there are none."""
    digits = F.regexp_replace(F.substring(seed, 2, 2), "[^0-9]", "")
    return F.when(digits != "", digits.cast("int"))


def logistic(x: Column, width: float = LOGISTIC_WIDTH) -> Column:
    return 1.0 / (1.0 + F.exp(-x / width))


def temper(p: Column, t: Column | float) -> Column:
    """Temperature scaling of a probability, clipped to [1e-7, 1 - 1e-7] first."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.when(p.isNotNull(), 1.0 / (1.0 + F.exp(-F.log(q / (1.0 - q)) / t)))


def moneyline_of(p: Column) -> Column:
    """American moneyline of a probability clamped to [0.01, 0.99], rounded half to even."""
    q = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    line = F.when(q >= 0.5, -100.0 * q / (1.0 - q)).otherwise(100.0 * (1.0 - q) / q)
    return F.when(p.isNotNull(), F.bround(line, 0).cast("int"))


def implied_probability(line: Column) -> Column:
    return F.when(line < 0, -line / (-line + 100.0)).when(line >= 0, 100.0 / (line + 100.0))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def spread_probability(spread: Column, sigma: float = SPREAD_SIGMA) -> Column:
    """Probability that the side with this spread (negative: favoured) wins."""
    return normal_cdf(-spread / sigma)


def maturity_blend(asof: Column, prior: Column, games: Column, k: float = 8.0) -> Column:
    """min(games/k, 1) of the as-of value and the rest of the prior; one missing: the other; both missing: 0."""
    w = F.least(games / k, F.lit(1.0))
    w = F.when(asof.isNull(), 0.0).when(prior.isNull(), 1.0).otherwise(w)
    return w * F.coalesce(asof, F.lit(0.0)) + (1.0 - w) * F.coalesce(prior, F.lit(0.0))


def scores_from(total: Column, margin: Column) -> tuple[Column, Column]:
    return (total + margin) / 2.0, (total - margin) / 2.0


def rank_share(value: str, by: list[str]) -> Column:
    """Average rank (ties averaged) within ``by`` as a share of its rows with a value; null stays null."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), (first + (ties - 1) / 2.0) / F.count(value).over(Window.partitionBy(*by)))


def abbreviation(name: Column) -> Column:
    """Initials of a name of several words, else its first four letters, in capitals."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.upper(F.when(F.size(words) > 1, F.substring(initials, 1, 4)).otherwise(F.substring(F.element_at(words, 1), 1, 4)))


def normalised_name(name: Column) -> Column:
    """Lower case without dots, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\.", ""), r"\s+", " "))


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def right_closed_label(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin (low, high] that holds x; null beyond the edges."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = out.when((x > lo) & (x <= hi), label)
    return out
