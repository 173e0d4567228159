"""Small groups are linked and thinned within a task each, without rounds or pairs, and equal what rounds give."""

import random

import pytest

from plumbline.operators import rounds


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(9)
    made = [(i % 3 or None, i, i % 4 or None, round(r.uniform(0, 3), 1), round(r.uniform(0, 3), 1)) for i in range(150)] + [(1, 500, 0, None, 0.0)]
    return spark.createDataFrame(made, "g long, k long, walk long, x double, y double").repartition(3)


def both(monkeypatch, call, step):
    calls, real = [], getattr(rounds, step)
    monkeypatch.setattr(rounds, step, lambda *a, **b: calls.append(1) or real(*a, **b))
    small = call()
    # Of no rows, rounds may look for pairs once.
    assert len(calls) <= 1
    monkeypatch.setattr(rounds, "MOST_TOGETHER", 0)
    return small, call(), len(calls)


def test_complete_link_of_small_groups(rows, monkeypatch):
    call = lambda: sorted((v.g or 0, v.k, v.cluster) for v in rounds.complete_link(rows, ["g"], "k", ["x", "y"], 0.7).collect())
    small, large, calls = both(monkeypatch, call, "within")
    known = [v for v in small if v[0]]
    assert len(small) == 151 and (1, 500, 500) in small and calls
    # In rounds rows of a null group get lost.
    assert known == [v for v in large if v[0]]


@pytest.mark.parametrize("side", [None, "walk"])
@pytest.mark.parametrize("touching", [True, False])
def test_first_apart_of_small_groups(rows, monkeypatch, side, touching):
    named = rows.filter("g is not null")
    call = lambda: sorted((v.g, v.k, v.kept_as) for v in rounds.first_apart(named, ["g"], "k", ["x", "y"], 0.5, side=side, touching=touching).collect())
    small, large, calls = both(monkeypatch, call, "_winners")
    assert small == large and calls


def test_first_apart_keeps_a_null_group_apart(rows):
    got = {v.k: v.kept_as for v in rounds.first_apart(rows, ["g"], "k", ["x", "y"], 0.5).collect() if v.g is None}
    assert len(got) == 50 and len(set(got.values())) < 50 and all(k % 3 == 0 for k in got.values())
