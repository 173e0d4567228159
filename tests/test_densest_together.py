import random

from plumbline.operators import rounds


def test_small_groups_need_no_rounds_and_equal_them(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i % 3 or None, i, round(r.uniform(0, 3), 1), round(r.uniform(0, 3), 1)) for i in range(120)] + [(1, 500, None, 0.0)]
    df = spark.createDataFrame(rows, "g long, k long, x double, y double")
    call = lambda: sorted(((v.g or 0, v.k, v.n) for v in rounds.densest(df, ["g"], "k", ["x", "y"], 0.5).collect()))
    want, at_round = [], rounds._winners
    for g in (None, 1, 2):
        left = [v for v in rows if v[0] == g and v[2] is not None]
        near = lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 0.5
        while left:
            n, k = min((-sum(near(a, b) for b in left), a[1]) for a in left)
            best = next(a for a in left if a[1] == k)
            want.append((g or 0, k, -n))
            left = [a for a in left if not near(a, best)]
    want = sorted([*want, (1, 500, 1)])
    calls = []
    monkeypatch.setattr(rounds, "_winners", lambda *a: calls.append(1) or at_round(*a))
    assert call() == want and not calls
    monkeypatch.setattr(rounds, "MOST_TOGETHER", 0)
    # In rounds a null group's rows meet no other row.
    assert [v for v in call() if v[0]] == [v for v in want if v[0]] and calls
