"""Few keys against many rows: no join by shuffles brings a key's rows to one task, and nearest values need no pairs."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import tables
from plumbline.operators import seq, spatial
from plumbline.plans import directives


def test_rows_are_sent_only_if_they_are_few(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_SENT", 5)
    plan = lambda n: spark.range(50).join(tables.sent(spark.range(n)), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(5) and "BroadcastHashJoin" not in plan(6)


def test_values_of_few_groups_stay_in_their_tasks(spark, monkeypatch):
    made, real = [], seq.cut
    monkeypatch.setattr(seq, "cut", lambda df: made.append(df._jdf.queryExecution().toString()) or real(df))
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r.q for r in seq.percentiles(rows, "g", "v", [0.5]).collect()}
    assert got == {0: [499.5], 1: [499.0], 2: [500.0]}
    assert all("SortMergeJoin" not in p for p in made)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_triggered_with_few_and_many_kinds(spark, monkeypatch, sent):
    monkeypatch.setattr(tables, "MOST_SENT", sent)
    asked = spark.createDataFrame([("a", "kitch", ["tab"]), ("b", None, None), ("c", "hall", ["x"])], "id string, typology string, entities array<string>")
    scenes = spark.createDataFrame([(1, "Kitchen"), (2, "kitchen"), (3, "hall")], "scene long, typology string")
    tokens = spark.createDataFrame([(1, "Table"), (1, "table"), (2, "chair"), (3, "table")], "scene long, token string")
    found = directives.triggered(asked, scenes, tokens)
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]
    if sent:
        # What kinds and tokens trigger is sent to the scenes' tasks.
        assert found._jdf.queryExecution().toString().count("BroadcastHashJoin") >= 2


def test_nearest_along_a_line(spark, monkeypatch):
    monkeypatch.setattr(spatial, "within", None)
    r = random.Random(6)
    at = [r.choice([0.0, -0.0, 0.25, 0.5, 1.0]) if i % 2 else round(r.uniform(-2, 9), 2) for i in range(200)]
    rows = [(i % 3 or None, i, x) for i, x in enumerate(at)] + [(1, 500, None), (1, 501, float("nan")), (7, 502, 1.0)]
    df = spark.createDataFrame(rows, "g long, k long, x double")
    seen = [v for v in rows if v[1] % 4 == 0 and v[0] and v[1] < 500]
    want = {k: min((abs(x - b), o) for h, o, b in seen if h == g) for g, k, x in rows[:200] if g and k % 4}
    got = spatial.nearest_of(df.filter("k % 4 <> 0"), df.filter("k % 4 = 0"), "k", ["x"], "g", 0.01)
    assert {v.k: (v.distance, v.other) for v in got.collect()} == want
