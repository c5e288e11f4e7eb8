"""How often the streams touch their state, and how often a landed log is computed."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from boutlake.streaming import results


class Held:
    def __init__(self):
        self.entries, self.calls = [], 0

    def _did(self, value=None):
        self.calls += 1
        return value

    def appendValue(self, v):
        self._did(self.entries.append(v))

    def get(self):
        return self._did(iter(list(self.entries)) if isinstance(self.entries, list) else self.entries)

    def clear(self):
        self._did(self.entries.clear())

    def exists(self):
        return self._did(bool(self.entries))

    def update(self, v):
        self.entries = v
        self._did()


def test_ratings_are_read_and_written_once_a_batch():
    rnd, day = random.Random(4), results.DAY_MS
    games = pd.DataFrame([(d * day, i * 10 + d, 2000, *rnd.sample(range(40), 2)) for d in range(6) for i in range(50)], columns=["ms", "seq", "Season", "WTeamID", "LTeamID"]).sample(frac=1, random_state=1)
    p, held, known = results.EloProcessor(), Held(), Held()
    p.init(SimpleNamespace(getListState=lambda *a: held, getValueState=lambda *a: known, registerTimer=lambda t: None))
    told = []
    for first, last in ((0, 3), (3, 6)):
        list(p.handleInputRows((0,), iter([games[(games.ms >= first * day) & (games.ms < last * day)]]), None))
        told += list(p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: (last - 1) * day), SimpleNamespace(getExpiryTimeInMs=lambda: 1)))
    assert held.calls + known.calls <= 14
    elo, want = {}, {}
    for r in games.sort_values(["ms", "seq"]).itertuples():
        a, b = elo.get(r.WTeamID, 1000.0), elo.get(r.LTeamID, 1000.0)
        want[r.seq] = (a, b)
        delta = 60.0 * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0)))
        elo[r.WTeamID], elo[r.LTeamID] = a + delta, b - delta
    got = pd.concat(told)
    assert len(got) == 250  # the last day is still held
    for r in got.itertuples():
        assert (r.W_Elo_pre, r.L_Elo_pre) == pytest.approx(want[r.seq])


def test_log_is_computed_once_for_all_files(spark):
    from pyspark.sql import functions as F

    from boutlake.plans.catalog_stream import feed

    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: (seen.add(1), True)[1], "boolean").asNondeterministic()
    g = spark.range(30).select(F.col("id").alias("_seq"), F.lit(2000).alias("Season"), (F.col("id") * 12).cast("int").alias("DayNum")).where(told("_seq"))
    feed(spark, "", g, parts=3, closing=False, whole=True)
    assert seen.value == 30
