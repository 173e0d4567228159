"""Checks on hand-made scenes, shapes of arrangements, and image scores against numpy."""

import math

import numpy as np
import pytest

from plumbline.operators import images
from plumbline.plans import checks

SCHEMA = "scene long, id long, role string, x double, y double, width double, depth double, bottom double, top double, run double, rise double"


def scene(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (11 - len(r))) for r in rows], SCHEMA)


def seen(df):
    return {(r.check, r.id): (r.outcome, r.measured) for r in df.collect()}


def test_checks_of_a_room(spark):
    room = [
        (1, 1, "wall", 0.0, 100.0, 4.0, 200.0, 0.0, 100.0), (1, 2, "wall", 100.0, 200.0, 200.0, 4.0, 0.0, 100.0),
        (1, 5, "toilet", 19.0, 180.0, 15.0, 28.0, 0.0, 17.0), (1, 6, "bar", 3.0, 178.0, 2.0, 42.0, 32.0, 33.5), (1, 7, "bar", 20.0, 197.0, 36.0, 2.0, 36.0, 37.0),
        (1, 8, "counter", 100.0, 50.0, 60.0, 24.0, 0.0, 42.0), (1, 9, "lowered", 160.0, 50.0, 36.0, 24.0, 0.0, 36.0), (1, 10, "reader", 100.0, 50.0, 4.0, 4.0, 42.5, 47.0), (1, 11, "reader", 300.0, 300.0, 4.0, 4.0, 36.0, 40.0),
        (1, 12, "sink", 60.0, 190.0, 20.0, 18.0, 25.0, 34.5), (1, 13, "mirror", 60.0, 198.0, 18.0, 1.0, 40.0, 70.0), (1, 14, "mirror", 150.0, 198.0, 18.0, 1.0, 50.0, 70.0),
        (1, 15, "mounted", 4.5, 100.0, 5.0, 20.0, 40.0, 60.0), (1, 16, "mounted", 90.0, 100.0, 5.0, 20.0, 40.0, 60.0), (1, 17, "mounted", 3.0, 100.0, 2.0, 20.0, 27.0, 60.0),
        (1, 18, "control", 3.0, 60.0, 2.0, 4.0, 20.0, 48.0), (1, 19, "control", 3.0, 60.0, 2.0, 4.0, 40.0, 50.0), (1, 20, "control", 3.0, 60.0, 2.0, 4.0, 49.0, 50.0), (1, 21, "door", 60.0, 0.0, 36.0, 4.0, 0.0, 80.0),
        (1, 30, "table", 0.0, 0.0, 30.0, 30.0, 0.0, 27.8), (1, 31, "table", 0.0, 0.0, 30.0, 30.0, 0.0, 40.0),
        (2, 40, "counter", 100.0, 50.0, 60.0, 24.0, 0.0, None), (2, 41, "toilet", 90.0, 180.0, 15.0, 28.0, 0.0, 17.0), (2, 42, "reader", 100.0, 50.0, 4.0, 4.0, 42.5, 47.0), (2, 43, "table", 0.0, 0.0, 30.0, 30.0, 0.0, 30.0),
        (3, 50, "ramp", 50.0, 50.0, 40.0, 100.0, 0.0, 8.0, 96.0, 8.0), (3, 51, "landing", 50.0, -30.0, 60.0, 60.0, 0.0, 1.0), (3, 52, "landing", 50.0, 130.0, 60.0, 59.0, 0.0, 1.0), (3, 53, "rail", 30.0, 50.0, 2.0, 90.0, 0.0, 39.0), (3, 54, "rail", 70.0, 50.0, 2.0, 90.0, 0.0, 35.0),
        (4, 60, "ramp", 50.0, 50.0, 30.0, 100.0, 0.0, 0.0, 96.0, 0.0),
    ]
    got = seen(checks.all_checks(scene(spark, room)))
    assert got["service_counter_height", 9] == ("passes", 36) and ("service_counter_height", 8) not in got and got["service_counter_height", 40] == ("question", None)
    assert got["point_of_sale_height", 10] == ("problem", 42) and got["point_of_sale_height", 11] == ("question", None) and ("point_of_sale_height", 42) not in got
    assert got["water_closet_location", 5] == ("passes", 17) and got["water_closet_location", 41] == ("question", None)
    assert got["grab_bar_lengths", 5] == ("passes", 0) and got["grab_bar_lengths", 41] == ("question", None)
    assert got["grab_bar_height", 6][0] == "passes" and got["grab_bar_height", 7][0] == "problem"
    assert got["lavatory_rim", 12][0] == "problem" and got["lavatory_mirror", 13][0] == "passes" and ("lavatory_mirror", 14) not in got
    assert got["protruding_objects", 15] == ("problem", 5) and got["protruding_objects", 16] == ("question", None) and ("protruding_objects", 17) not in got
    assert [got["reach_range", i][0] for i in (18, 19, 20)] == ["passes", "question", "problem"] and got["door_clear_width", 21] == ("question", 36)
    assert got["dining_surface_height", 30] == ("question", 0) and got["dining_surface_height", 43] == ("passes", 1)
    assert got["ramp_slope", 50] == ("passes", 12) and got["ramp_rise", 50][0] == "passes" and got["ramp_width", 50][0] == "passes" and got["ramp_landings", 50] == ("problem", 59)
    assert got["ramp_handrails", 50] == ("passes", 2) and got["ramp_rail_height", 50] == ("problem", 39)
    assert got["ramp_slope", 60] == ("passes", None) and got["ramp_width", 60][0] == "problem" and got["ramp_landings", 60] == ("question", None) and got["ramp_handrails", 60][0] == "passes" and ("ramp_rail_height", 60) not in got
    assert checks.all_checks(scene(spark, [])).count() == 0


def test_uncertainty_and_the_matrix(spark):
    tops = [(1, i, "lowered", 0.0, 0.0, 1.0, 1.0, 0.0, t) for i, t in enumerate((35.4, 35.6, 36.0, 36.4, 36.6))]
    got = seen(checks.counter_heights(scene(spark, tops), uncertainty=0.5))
    assert [got["service_counter_height", i][0] for i in range(5)] == ["passes", "question", "question", "question", "problem"]
    rules = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "rule string, enabled boolean")
    observed = spark.createDataFrame([(1, "a", 1, "passes"), (1, "a", 2, "question"), (2, "a", 3, "problem"), (2, "b", 3, "problem"), (2, "z", 3, "passes")], "scene long, check string, id long, outcome string")
    scenes = spark.createDataFrame([(1,), (2,)], "scene long")
    matrix = {(r.scene, r.rule): (r.outcome, r.n) for r in checks.compliance(rules, scenes, observed).collect()}
    assert matrix == {(1, "a"): ("question", 2), (1, "b"): ("off", 0), (1, "c"): ("not evaluated", 0), (2, "a"): ("problem", 1), (2, "b"): ("off", 1), (2, "c"): ("not evaluated", 0), (2, "z"): ("not listed", 1)}


def test_shapes_of_arrangements(spark):
    grid = [(30.0 + 40 * (i % 3), 30.0 + 40 * (i // 3)) for i in range(9)]
    ring = [(110 + 100 * math.cos(a), 160 + 140 * math.sin(a)) for a in np.linspace(0, 6, 7).tolist()]
    sets = {
        "one": [(1.0, 1.0)], "pair": [(1.0, 1.0), (90.0, 3.0)], "row": [(10.0, 5.0), (50.0, 6.0), (90.0, 5.0)], "two_rows": [(30.0, 30.0), (90.0, 30.0), (30.0, 90.0), (90.0, 90.0)],
        "grid": grid, "ring": [(10.0, 40.0), (10.0, 200.0), (80.0, 8.0), (230.0, 120.0), (150.0, 310.0)], "cluster": [(100.0, 150.0), (115.0, 162.0), (130.0, 171.0)], "spread": [*ring[:4], (110.0, 160.0), (60.0, 110.0)],
    }
    rows = [(1, name, 100 * n + i, float(x), float(y), 5.0, 4.0) for n, (name, at) in enumerate(sets.items()) for i, (x, y) in enumerate(at)]
    walls = spark.createDataFrame([(1, 120.0, 0.0, 240.0, 4.0), (1, 120.0, 320.0, 240.0, 4.0), (1, 0.0, 160.0, 4.0, 320.0), (1, 240.0, 160.0, 4.0, 320.0)], "scene long, x double, y double, width double, depth double")
    got = {r.subject: r for r in checks.arrangements(spark.createDataFrame(rows, "scene long, subject string, id long, x double, y double, width double, depth double"), walls).collect()}
    assert {k: r["shape"] for k, r in got.items()} == {k: k for k in sets}
    assert (got["grid"]["rows"], got["grid"]["columns"], got["grid"]["row_spacing"]) == (3, 3, 40.0) and got["one"]["row_spacing"] is None


def test_image_scores_against_numpy(spark):
    r = np.random.default_rng(3)
    a = r.random((20, 24, 3))
    b = np.clip(a + r.normal(0, 0.05, a.shape), 0, 1)
    keep = np.ones((20, 24), bool)
    keep[3, 4] = keep[17, 20] = False
    rows = [(i, y, x, c, float(a[y, x, c]), float((b if i else a)[y, x, c]), bool(keep[y, x])) for i in (0, 1) for y in range(20) for x in range(24) for c in range(3)]
    rows += [(2, 0, 0, 0, 0.5, 0.5, None), (2, 0, 1, 0, None, 0.5, True)]
    got = {v.image: v for v in images.scores(spark.createDataFrame(rows, "image long, y int, x int, channel int, a double, b double, keep boolean")).collect()}
    w = np.outer(images.weights(), images.weights())[..., None]
    index = []
    for y in range(5, 15):
        for x in range(5, 19):
            if keep[y - 5 : y + 6, x - 5 : x + 6].all():
                p, q = a[y - 5 : y + 6, x - 5 : x + 6], b[y - 5 : y + 6, x - 5 : x + 6]
                mean = lambda v: (w * v).sum((0, 1))
                ma, mb = mean(p), mean(q)
                index.append((2 * ma * mb + images.C1) / (ma**2 + mb**2 + images.C1) * (2 * (mean(p * q) - ma * mb) + images.C2) / (mean(p * p) - ma**2 + mean(q * q) - mb**2 + images.C2))
    mse = ((a - b) ** 2)[keep].mean()
    assert got[1].mse == pytest.approx(mse) and got[1].psnr == pytest.approx(10 * math.log10(1 / mse)) and got[1].ssim == pytest.approx(np.mean(index))
    assert got[0].mse == 0 and got[0].psnr == 100 and got[0].ssim == pytest.approx(1)
    assert got[2].mse is None and got[2].psnr is None and got[2].ssim is None
    shares = spark.createDataFrame([(1, 0.2, True), (1, 0.01, True), (1, 0.01, False), (2, 0.9, True)], "image long, alpha double, supported boolean")
    assert {v.image: v.uncovered for v in images.uncovered(shares, 0.05).collect()} == {1: 0.5, 2: 0.0}
