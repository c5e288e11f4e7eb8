"""Fuzzy names against all pairs by difflib."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from boutlake.operators import match


def test_name_that_differs_near_both_ends(spark):
    t = spark.createDataFrame([(1, "Northwestern Oklahoma State University")], "TeamID int, TeamName string")
    none = spark.createDataFrame([], "spelling string, TeamID int")
    names = spark.createDataFrame([("Xerthwestern Oklahoma State Universizz",)], "name string")
    got = match.resolve_names(names, t, none, none.withColumnRenamed("spelling", "name")).first()
    assert (got.TeamID, got.how) == (1, "fuzzy")


@pytest.mark.parametrize("cutoff", [0.5, 0.7, 0.85, 1.0])
def test_no_pair_is_left_out(spark, cutoff):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 25))) for _ in range(60)]

    def bent(w):
        chars = list(w)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(chars))
            chars[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
        return "".join(chars)

    names, others = sorted({bent(w) for w in words} - {""}), sorted(set(words) - {""})
    left = spark.createDataFrame([(n, n) for n in names], "name string, norm string")
    right = spark.createDataFrame([(o, i) for i, o in enumerate(others)], "other string, TeamID int")
    got = {(r.name, r.other) for r in match.alike(left, right, cutoff).collect()}
    assert got == {(n, o) for n in names for o in others if SequenceMatcher(None, o, n).ratio() >= cutoff}
