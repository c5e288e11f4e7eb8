"""The most alike name against all pairs by difflib, and how many pairs it takes."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from boutlake.operators import match


@pytest.mark.parametrize("cutoff", [0.5, 0.85])
def test_best_of_all_pairs(spark, cutoff):
    rnd = random.Random(8)
    others = sorted({"".join(rnd.choice("abé 12") for _ in range(rnd.randint(1, 14))) for _ in range(70)})
    names = sorted({"".join(rnd.sample(o, len(o))) if rnd.random() < 0.3 else o[:-1] + rnd.choice("az1") for o in others})
    left = spark.createDataFrame([(n, n) for n in names] + [("none", None)], "name string, norm string")
    right = spark.createDataFrame([(o, i) for i, o in enumerate(others)], "other string, TeamID int")
    want = {}
    for n in names:
        ratio, o = max((SequenceMatcher(None, o, n).ratio(), o) for o in others)
        if ratio >= cutoff:
            want[n] = (o, ratio)
    assert {r.name: (r.other, r.ratio) for r in match.most_alike(left, right, cutoff).collect()} == want


def test_names_of_one_pattern_are_not_compared_in_all_pairs(spark, monkeypatch):
    n = 3000
    right = spark.range(n).selectExpr("concat('supplier#', lpad(id, 9, '0')) AS other", "int(id) AS TeamID")
    left = right.where("TeamID % 10 = 0").selectExpr("replace(other, 'pp', 'p') AS name", "replace(other, 'pp', 'p') AS norm")
    pairs, real = spark.sparkContext.accumulator(0), match.likeness

    def counted(a, b):
        from pyspark.sql import functions as F

        one = F.udf(lambda x: (pairs.add(1), x)[1], "string")
        return real(a, b) + F.length(one(F.col(a))) * 0.0

    monkeypatch.setattr(match, "likeness", counted)
    got = match.most_alike(left, right, 0.85).collect()
    assert len(got) == n // 10 and all(r.name == r.other.replace("pp", "p") for r in got)
    assert pairs.value < 40 * len(got)
