"""The ratings' stream hands few rows to its processor, and batch and stream equal a plain replay over seasons."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutlake.operators import history
from boutlake.streaming import results


def games():
    rnd = random.Random(9)
    return [(p * 10**6 + s * 1000 + i, p, s, i // 10, *rnd.sample(range(30), 2)) for p in (0, 1) for s in (1999, 2000, 2002) for i in range(150)]


def replay(rows, base=1000.0, k=60.0, width=400.0, carry=0.9):
    elo, seen, out = {}, {}, {}
    for seq, p, s, _, w, l in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        for t in ((p, w), (p, l)):
            if seen.get(t) != s:
                elo[t] = base + carry * (elo[t] - base) if t in elo else base
                seen[t] = s
        a, b = elo[p, w], elo[p, l]
        out[seq] = (a, b)
        delta = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / width)))
        elo[p, w], elo[p, l] = a + delta, b - delta
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "_seq long, men_women int, Season int, DayNum int, WTeamID int, LTeamID int")


def test_batch_equals_a_replay(spark):
    got = {r._seq: (r.W_Elo_pre, r.L_Elo_pre) for r in history.pregame_elo(frame(spark, games()), k=60.0, carry=0.9).collect()}
    assert got == {k: pytest.approx(v) for k, v in replay(games()).items()}


def test_packed_days_equal_a_replay_and_are_few(spark):
    rows = [*games(), (-1, None, None, None, None, None)]
    at = F.coalesce(F.make_date("Season", F.lit(1), F.lit(1)).cast("timestamp") + F.make_dt_interval("DayNum"), F.lit("2004-01-01").cast("timestamp"))
    slim = frame(spark, rows).withColumn("at", at).withColumnRenamed("_seq", "seq").coalesce(1)
    packs = results.by_day(slim, results.EloProcessor.rows).toPandas()
    assert len(packs) == 2 * 3 * 15 + 1 and packs[packs.men_women.isna()].rows.tolist() == [b""]  # the closing row is kept, of no game
    want, got = replay(games()), {}
    for pool in (0, 1):
        held, known = [], []
        state = SimpleNamespace(appendValue=held.append, get=lambda h=held: iter(list(h)), clear=held.clear)
        value = SimpleNamespace(exists=lambda k=known: bool(k), get=lambda k=known: k[-1], update=known.append)
        p = results.EloProcessor()
        p.init(SimpleNamespace(getListState=lambda *a, s=state: s, getValueState=lambda *a, v=value: v, registerTimer=lambda t: None))
        own = packs[packs.men_women == pool].sample(frac=1, random_state=3)
        for first, last in (("1999-01-01", "2000-01-08"), ("2000-01-08", "2003-01-01")):
            part = own[(own["at"] >= first) & (own["at"] < last)]
            list(p.handleInputRows((pool,), iter([part]), None))
            now = int(pd.Timestamp(last).timestamp() * 1000)
            for told in p.handleExpiredTimer((pool,), SimpleNamespace(getCurrentWatermarkInMs=lambda n=now: n), SimpleNamespace(getExpiryTimeInMs=lambda: 1)):
                got |= {r.seq: (r.W_Elo_pre, r.L_Elo_pre) for r in told.itertuples()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert np.dtype(results.EloProcessor.rows).itemsize * 900 == sum(map(len, packs.rows))
