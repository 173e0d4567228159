"""Spatial joins on odd rows, exact footprints, containment of strings, digests and directives, against brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import containment, footprints, rel, spatial
from plumbline.plans import directives
from plumbline.streaming import jobs


def test_closest_pairs_end_whatever_the_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1, 0.0, None), ("a", 2, 1.0, 1.0), ("b", 3, nan, 0.0), ("b", 4, 0.0, inf), ("c", 5, 0.0, 0.0), ("c", 6, 3e9, 0.0), ("d", 7, 1.0, 1.0), ("d", 7, 1.0, 1.0), (None, 8, 0.0, 0.0), (None, 9, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "g string, k long, x double, y double")
    assert [tuple(r) for r in spatial.closest_pairs(points, "k", ["x", "y"], "g", 0.5).collect()] == [("c", 5, 6, 3e9)]
    near = spatial.nearest_of(points, points.filter("k in (2, 6)"), "k", ["x", "y"], "g", 0.5)
    assert {(r.k, r.other, r.distance) for r in near.collect()} == {(2, 2, 0.0), (5, 6, 3e9), (6, 6, 0.0)}
    assert spatial.nearest_of(points.limit(0), points, "k", ["x", "y"], "g", 0.5).count() == 0


def test_nearest_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, i % 3, r.gauss(0, 1) * 10 ** r.randrange(-2, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g long, x double")
    got = {v.k: v.other for v in spatial.nearest_of(df.filter("k % 4 <> 0"), df.filter("k % 4 = 0"), "k", ["x"], "g", 0.01).collect()}
    for k, g, x in rows:
        if k % 4:
            assert got[k] == min((abs(x - y), j) for j, h, y in rows if h == g and j % 4 == 0)[1]


def test_footprints_of_known_shapes(spark):
    rows = [
        (1, 0.0, 0.0, 1.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0, 1.0, math.pi / 4), (3, 2.5, 0.0, 1.0, 1.0, 0.0), (4, 0.0, 0.0, 0.25, 0.25, 0.3),
        (5, 2.0, 2.0, 1.0, 1.0, 0.0), (6, None, 0.0, 1.0, 1.0, 0.0), (7, float("nan"), 0.0, 1.0, 1.0, 0.0), (8, 100.0, 0.0, 1.0, 1.0, 0.0),
    ]
    boxes = spark.createDataFrame(rows, "id long, cx double, cy double, half_x double, half_y double, angle double")
    got = {(r.id, r.other): (round(r.gap, 9), round(r.overlap, 9)) for r in footprints.near_footprints(boxes, "id", 0.6).collect()}
    octagon = 8 * (math.sqrt(2) - 1)
    assert got[1, 2] == (0, pytest.approx(octagon)) and got[1, 4] == (0, 0.25) and got[2, 4] == (0, 0.25)
    assert got[1, 3] == (0.5, 0) and got[1, 5] == (0, 0) and got[2, 3][0] == pytest.approx(1.5 - math.sqrt(2))
    assert got[3, 5] == (0, 0) and (3, 4) not in got and not {6, 7, 8} & {x for pair in got for x in pair}
    assert footprints.near_footprints(boxes.limit(0), "id", 0.6).count() == 0


def test_segments_against_all_pairs(spark):
    r = random.Random(6)
    at = lambda: (round(r.uniform(-3, 3), 1), round(r.uniform(-3, 3), 1))
    lines = [(i, *at(), *at()) for i in range(60)]
    # A point, an upright line, a level one, and one that lies on another.
    lines += [(60, 1.0, 1.0, 1.0, 1.0), (61, 0.5, -2.0, 0.5, 2.0), (62, -2.0, 0.5, 2.0, 0.5), (63, -1.0, 0.5, 5.0, 0.5), (64, None, 0.0, 0.0, 0.0)]

    def to(p, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = max(0, min(1, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)

    def apart(a, b):
        side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
        if side(a, *b[:2]) * side(a, *b[2:]) < 0 and side(b, *a[:2]) * side(b, *a[2:]) < 0:
            return 0.0
        return min(to(a[:2], b), to(a[2:], b), to(b[:2], a), to(b[2:], a))

    df = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    for radius, cell in ((0.3, 0.7), (0.0, 2.5), (1.5, 0.4)):
        got = {(v.p, v.s): v.distance for v in footprints.near_segments(df.withColumnRenamed("id", "p"), df.withColumnRenamed("id", "s"), "p", "s", radius, cell).collect()}
        want = {(a[0], b[0]): apart(a[1:], b[1:]) for a in lines[:-1] for b in lines[:-1]}
        sure = {k: v for k, v in want.items() if v <= radius - 1e-9 or v == 0}
        assert sure.keys() <= got.keys() <= {k for k, v in want.items() if v <= radius + 1e-9}
        assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in sure.items())


def test_containment_against_all_pairs(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 9))) for _ in range(120)] + [None, ""]
    needles = ["".join(r.choice("abc é") for _ in range(r.randrange(0, 5))) for _ in range(60)] + [None, "", "a%", "_"]
    n, t = spark.createDataFrame([(x,) for x in needles], "n string"), spark.createDataFrame([(x,) for x in texts], "t string")
    got = [tuple(v) for v in containment.held_in(n, t, "n", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in needles if a for b in texts if b is not None and a in b}
    words = {(a, b) for a in needles if a and a.strip() for b in texts if b is not None and all(w in b for w in a.split(" ") if w)}
    assert {tuple(v) for v in containment.all_words_in(n, t, "n", "t").collect()} == words
    assert containment.held_in(n.limit(0), t, "n", "t").count() == 0


def test_directives_are_read_and_triggered(spark, tmp_path):
    corpus = [
        {"id": "bath", "verified": True, "trigger": {"typology": "Bathroom", "entities": ["SINK", "toilet"]}, "inspection_queries": ["a", "b"], "constraints": [{"check": "reach", "piece": "sink"}]},
        {"id": "any", "verified": True, "trigger": {"entities": ["door"]}}, {"id": "all baths", "verified": True, "trigger": {"typology": "bath"}},
        {"id": "draft", "verified": False, "trigger": {"typology": "bath"}}, {"id": "silent", "trigger": {}}, {"verified": True}, {"other": 1},
    ]
    (tmp_path / "d.json").write_text("\n".join([*map(json.dumps, corpus), "", "not json"]))
    read = directives.read_directives(spark, str(tmp_path))
    assert {r.id for r in read.collect()} == {"bath", "any", "all baths"}
    assert {r.id for r in directives.read_directives(spark, str(tmp_path), preview=True).collect()} == {"bath", "any", "all baths", "draft", "silent"}
    assert [tuple(r) for r in directives.inspections(read).orderBy("place").collect()] == [("bath", 0, "a"), ("bath", 1, "b")]
    scenes = spark.createDataFrame([(1, "bath"), (2, "small bathroom"), (3, "shop"), (4, None)], "scene long, typology string")
    tokens = spark.createDataFrame([(1, "kitchen sink"), (2, "stool"), (3, "front Door"), (3, "door"), (4, "door"), (1, None)], "scene long, token string")
    got = sorted(tuple(r) for r in directives.triggered(read, scenes, tokens).collect())
    assert got == [(1, "all baths"), (1, "bath"), (2, "all baths"), (3, "any")]


def test_digests_and_claims(spark):
    rows = spark.createDataFrame([(i % 3, f"r{i}") for i in range(90)] + [(5, None), (5, None), (6, "")], "k long, v string")
    a = {r.k: (r.rows, r.fingerprint) for r in rel.digest(rows, ["k"], F.col("v")).collect()}
    assert a == {r.k: (r.rows, r.fingerprint) for r in rel.digest(rows.orderBy(F.desc("v")).repartition(5), ["k"], F.col("v")).collect()}
    assert a[5][0] == 2 and len({x for _, x in a.values()}) == 5
    assert {r.k: r.fingerprint for r in rel.digest(rows.filter("v <> 'r0'"), ["k"], F.col("v")).collect()}[0] != a[0][1]
    queue = spark.createDataFrame([(i, "one" if i % 4 else "two", "queued" if i % 5 else "done") for i in range(400)], "job long, lane string, state string")
    workers = spark.createDataFrame([("one", "w1"), ("one", "w2"), ("two", "w3"), ("three", "w4")], "lane string, worker string")
    got = {r.worker: r.job for r in jobs.claims(queue, workers, "lane", ["job"]).collect()}
    assert got == {"w1": 1, "w2": 2, "w3": 4}
    assert jobs.claims(queue, workers.limit(0), "lane", ["job"]).count() == 0
