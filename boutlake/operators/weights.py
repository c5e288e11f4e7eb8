"""Search for the weights of a rating blend: candidates in batches, one aggregation a batch."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_weights(df: DataFrame, features: list[str], outcome: str, rounds: int = 3, parts: int = 4) -> tuple[list[float], float, float]:
    """Weights on the simplex with the least Brier score of logistic(weighted z-scores); also that score and equal weights' score.

    Features are z-scored with population deviations. The first batch is a lattice
    of the simplex, later ones move weight between pairs with halving steps. The
    driver holds only candidates and one score each.
    """
    k = len(features)
    stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [(F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0) for i, c in enumerate(features)]
    data = df.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], F.col(outcome).cast("double").alias("y"))

    def losses(batch: list[tuple[float, ...]]) -> list[float]:
        rating = lambda w: sum((F.col(f"z{i}") * x for i, x in enumerate(w)), F.lit(0.0))
        row = data.agg(*[F.avg((1.0 / (1.0 + F.exp(-rating(w))) - F.col("y")) ** 2).alias(f"c{i}") for i, w in enumerate(batch)]).first()
        return list(row)

    equal = tuple([1.0 / k] * k)
    lattice = [tuple(x / parts for x in c) for c in itertools.product(range(parts + 1), repeat=k) if sum(c) == parts]
    batch = [equal, *lattice]
    found = losses(batch)
    start = found[0]
    best = min(zip(found, batch))
    step = 0.5 / parts
    for _ in range(rounds):
        moves = []
        for i, j in itertools.permutations(range(k), 2):
            by = min(step, best[1][i])
            if by > 0:
                w = list(best[1])
                w[i], w[j] = w[i] - by, w[j] + by
                moves.append(tuple(w))
        best = min([best, *zip(losses(moves), moves)])
        step /= 2
    return list(best[1]), best[0], start
