"""Greedy choices in rounds, and choices along walks, against loops over the rows in order."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline import tables
from plumbline.operators import paths, rounds

NAN = float("nan")


def groups(rows):
    by = defaultdict(list)
    for g, *rest in sorted(rows):
        by[g].append(tuple(rest))
    return by


def dist(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


@pytest.fixture(scope="module")
def scattered(spark):
    r = random.Random(1)
    rows = [(g, i, r.gauss(0, 1), r.gauss(0, 1)) for g in (0, 1) for i in range(120)]
    # Copies, and one place that holds a third of all rows.
    rows += [(0, 1000 + i, *rows[i][2:]) for i in range(15)] + [(1, 2000 + i, 0.25, 0.25) for i in range(120)]
    return rows, spark.createDataFrame(rows, "g int, k long, x double, y double").repartition(5)


def with_odd(df):
    odd = df.sparkSession.createDataFrame([(0, 9001, None, 0.0), (0, 9002, NAN, 0.0), (0, 9003, float("inf"), 0.0)], df.schema)
    return df.union(odd).withColumns({"label": F.lit(1), "_c0": F.lit(2), "size": F.lit(3)})


ODD = {(0, k) for k in (9001, 9002, 9003)}


def test_spaced_selection_against_a_loop(scattered):
    rows, df = scattered
    want = set()
    for g, v in groups(rows).items():
        kept = []
        for k, *at in v:
            if all(dist(at, b) >= 0.5 for _, *b in kept):
                kept.append((k, *at))
                want.add((g, k))
    got = rounds.first_apart(with_odd(df), ["g"], "k", ["x", "y"], 0.5, touching=False).filter("kept_as = k").collect()
    assert {(r.g, r.k) for r in got} == want | ODD and len(got) == len(want) + 3
    assert rounds.first_apart(df.limit(0), ["g"], "k", ["x", "y"], 0.5).count() == 0


def test_copies_across_walks_against_a_loop(scattered):
    rows, df = scattered
    want = set()
    for g, v in groups(rows).items():
        kept = []
        for k, *at in sorted(v, key=lambda row: (row[0] % 7, row[0])):
            same = next((q for q, *b in kept if q % 3 != k % 3 and dist(at, b) <= 0.5), None)
            if same is None:
                kept.append((k, *at))
            want.add((g, k, k if same is None else same))
    got = rounds.first_apart(df.withColumn("walk", F.col("k") % 3), ["g"], "k", ["x", "y"], 0.5, order=[F.col("k") % 7], side="walk")
    assert {(r.g, r.k, r.kept_as) for r in got.collect()} == want


def test_densest_clusters_against_a_loop(scattered):
    rows, df = scattered
    want = set()
    for g, v in groups(rows).items():
        left = list(v)
        while left:
            n, k, *at = min((-sum(dist(a[1:], b[1:]) <= 0.5 for b in left), *a) for a in left)
            want.add((g, k, -n))
            left = [a for a in left if dist(a[1:], at) > 0.5]
    got = rounds.densest(with_odd(df), ["g"], "k", ["x", "y"], 0.5).collect()
    assert {(r.g, r.k, r.n) for r in got} == want | {(*o, 1) for o in ODD}
    assert rounds.densest(df.limit(0), ["g"], "k", ["x", "y"], 0.5).count() == 0


def test_complete_link_against_a_loop(scattered):
    rows, df = scattered
    want = set()
    for g, v in groups(rows).items():
        clusters = []
        for k, *at in v:
            own = next((c for c in clusters if all(dist(at, b) <= 0.7 for _, *b in c)), None)
            if own is None:
                clusters.append(own := [])
            own.append((k, *at))
            want.add((g, k, own[0][0]))
    got = rounds.complete_link(with_odd(df), ["g"], "k", ["x", "y"], 0.7).collect()
    assert {(r.g, r.k, r.cluster) for r in got} == want | {(*o, o[1]) for o in ODD}
    assert rounds.complete_link(df.limit(0), ["g"], "k", ["x", "y"], 0.7).count() == 0


@pytest.fixture(scope="module")
def walks(spark):
    r, rows = random.Random(2), []
    for g, n in ((0, 1500), (1, 200), (2, 200)):
        x = y = 0.0
        for i in range(n):
            angle = r.random() * 2 * math.pi
            # Now and then the walk stands still.
            x, y = (x, y) if r.random() < 0.1 else (x + 0.11 * math.cos(angle), y + 0.11 * math.sin(angle))
            rows.append((g, 3 * i + r.randrange(3), x, y))
    rows.append((7, 1, 0.0, 0.0))
    return rows, spark.createDataFrame(rows, "g int, k long, x double, y double").repartition(5)


def kept_in_order(rows, far):
    out = set()
    for g, v in groups(rows).items():
        last = None
        for row in v:
            if last is None or far(last, row):
                last = row
                out.add((g, row[0]))
    return out


CELL = lambda: F.floor(F.col("k") / 500)


def test_resampling_against_a_loop(walks):
    rows, df = walks
    got = paths.resampled(df, ["g"], "k", CELL(), ["x", "y"], 0.6).collect()
    assert {(r.g, r.k) for r in got} == kept_in_order(rows, lambda a, b: dist(a[1:], b[1:]) >= 0.6)
    assert paths.resampled(df.limit(0), ["g"], "k", CELL(), ["x", "y"], 0.6).count() == 0


def test_keyframes_against_a_loop(walks):
    rows, df = walks
    far = lambda a, b: b[0] - a[0] >= 100 or (b[0] - a[0] >= 4 and dist(a[1:], b[1:]) >= 0.5)
    got = paths.keyframes(df, ["g"], "k", CELL(), "k", ["x", "y"], 4.0, 100.0, 0.5).collect()
    assert {(r.g, r.k) for r in got} == kept_in_order(rows, far)


def test_sharpest_turns_against_a_loop(walks):
    rows, df = walks
    want = {}
    for g, v in groups(rows).items():
        arc = [0.0]
        for a, b in zip(v, v[1:], strict=False):
            arc.append(arc[-1] + dist(a[1:], b[1:]))
        for look in paths.LOOKS:
            for i in range(1, len(v) - 1):
                b = next(j for j in range(len(v)) if arc[j] >= arc[i] - look)
                a = next((j for j in range(i, len(v)) if arc[j] >= arc[i] + look), None)
                if a is None or arc[i] < look or dist(v[a][1:], v[b][1:]) > paths.CHORD_RATIO * (arc[a] - arc[b]):
                    continue
                p, q = [x - y for x, y in zip(v[i][1:], v[b][1:], strict=True)], [x - y for x, y in zip(v[a][1:], v[i][1:], strict=True)]
                sizes = math.hypot(*p) * math.hypot(*q)
                if sizes:
                    degrees = math.degrees(math.acos(max(-1, min(1, sum(x * y for x, y in zip(p, q, strict=True)) / sizes))))
                    if degrees > want.get(g, (None, -1))[1] + 1e-9:
                        want[g] = (v[i][0], degrees)
    got = {r.g: (r.k, r.degrees) for r in paths.sharpest_turns(df, ["g"], "k", CELL()).collect()}
    assert got.keys() == want.keys()
    for g, (k, degrees) in want.items():
        assert got[g] == (k, pytest.approx(degrees, abs=1e-6))


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.cut(Frame())
