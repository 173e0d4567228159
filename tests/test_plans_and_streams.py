import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import rel, seq
from plumbline.plans import rules, steps
from plumbline.sources import io
from plumbline.streaming import jobs

REGION = "id long, label string, width_m double, depth_m double, height_m double, footprint_m2 double, bottom_m double, top_m double, x_m double, y_m double, z_m double"


def region(spark, *rows):
    return spark.createDataFrame([(i, label, w, 1.0, 1.0, w, 0.0, top, x, 0.0, 0.0) for i, label, w, top, x in rows], REGION)


def test_plan_errors(spark):
    r = region(spark, (1, "a door", 0.7, 2.0, 0.0), (2, "a table", 1.0, 0.75, 3.0))
    with pytest.raises(steps.PlanError, match="unknown operation"):
        steps.compile_plan(r, [{"id": "x", "op": "drop"}])
    with pytest.raises(steps.PlanError, match="no earlier step"):
        steps.compile_plan(r, [{"id": "x", "op": "count", "of": "y"}])
    with pytest.raises(steps.PlanError, match="unknown field"):
        steps.compile_plan(r, [{"id": "a", "op": "every"}, {"id": "x", "op": "sum", "of": "a", "field": "price"}])
    with pytest.raises(steps.PlanError, match="must give number"):
        steps.compile_plan(r, [{"id": "a", "op": "every"}, {"id": "x", "op": "compare", "of": "a", "other": "a"}])
    with pytest.raises(Exception, match="exactly one region"):
        steps.compile_plan(r, [{"id": "a", "op": "every"}, {"id": "x", "op": "value", "of": "a", "field": "width_m"}]).collect()


def test_rules_hold_what_is_not_verified_and_question_what_straddles(spark):
    r = region(spark, (1, "door", 32 * X.INCH, 2.0, 0.0), (2, "door", 31.8 * X.INCH, 2.0, 0.0), (3, "door", 30 * X.INCH, 2.0, 0.0))
    got = {(x.rule_id, x.id): x.outcome for x in rules.evaluate(r, rules.RULES, uncertainty=0.25).collect()}
    assert got[("door_clear_width", 1)] == "question" and got[("door_clear_width", 2)] == "question"
    assert got[("door_clear_width", 3)] == "problem" and got[("grab_bars", None)] == "question"
    exact = {(x.rule_id, x.id): x.outcome for x in rules.evaluate(r, rules.RULES).collect()}
    assert exact[("door_clear_width", 1)] == "passes" and exact[("door_clear_width", 2)] == "problem"


def test_unknown_bounds_conclude_nothing(spark):
    df = spark.createDataFrame([(None, 5.0), (3.0, None), (3.0, 5.0), (4.0, 5.0)], "low double, high double")
    assert [r.v for r in df.select(X.interval_verdict(F.col("low"), F.col("high"), F.lit(4.0), "min").alias("v")).collect()] == ["needs_verification", "needs_verification", "needs_verification", "satisfied"]


def test_tree_with_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    got = rel.descendants(edges, spark.createDataFrame([("a",)], "root string")).collect()
    assert sorted((r.node, r.depth) for r in got) == [("a", 0), ("b", 1), ("c", 2)]


def test_evenly_spread_rounds_half_to_even(spark):
    df = spark.range(6).select(F.lit(1).alias("g"), "id")
    assert [r.id for r in seq.evenly_spread(df, ["g"], ["id"], 3).orderBy("id").collect()] == [0, 2, 5]
    assert seq.sample_without_replacement(10, 4, 3, 1) == [1, 4, 7, 0]


@pytest.mark.parametrize("form", ["admitted", "sampled", "settled"])
def test_streams_agree_with_batches(spark, tmp_path, form):
    rows = [(u, i, 1_700_000_000 + i * 40 + u, float(i % 7)) for u in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "user long, n long, s long, v double").select("user", "n", F.timestamp_seconds("s").alias("ts"), "v")
    for k in range(3):
        df.filter(f"n >= {10 * k} and n < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = {
        "admitted": lambda d: jobs.admitted(d.select("user", "n", "ts"), "user", "n", "ts", 300.0, 3),
        "sampled": lambda d: jobs.sampled(d, "user", "n", "ts", "v", 60.0, 400.0, 3.0),
        "settled": lambda d: jobs.settled(d, "user", "ts", "60 seconds").select("user", "n"),
    }[form]
    q = run(stream).writeStream.format("memory").queryName(form).outputMode("complete" if form == "settled" else "append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table(form).collect()))
    assert got and got == sorted(map(tuple, run(df).collect()))


def test_room_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "walls": [{"identifier": "w1", "category": {"wall": {}}, "confidence": {"high": {}}, "dimensions": [4, 3, 0], "transform": list(range(16))}],
        "objects": [{"category": "table", "dimensions": {"x": 1, "y": 0.7, "z": 2}, "transform": [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [5, 6, 7, 1]]}],
    }))
    got = {r.kind: r for r in io.read_rooms(spark, str(tmp_path / "a.json")).collect()}
    assert (got["wall"].id, got["wall"].category, got["wall"].confidence, got["wall"].x) == ("w1", "wall", "high", 4.0)
    assert (got["object"].confidence, got["object"].z, got["object"].matrix[12]) == ("low", 2.0, 5.0)
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="without elements"):
        io.read_rooms(spark, str(tmp_path / "b.json")).collect()


def test_mesh_logs_and_artifacts(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"parts": [{"id": "p", "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 20, 30, 1], "vertices": [1, 2, 3, 4, 5, 6], "triangles": [0, 1, 1]}]}))
    p = io.points(io.read_mesh(spark, str(tmp_path / "m.json"))).orderBy("i").collect()
    assert [(r.x, r.y, r.z) for r in p] == [(11, 22, 33), (14, 25, 36)]
    log = str(tmp_path / "log")
    assert io.read_log(spark, log, "a long").count() == 0
    io.append_log(spark.range(3).select(F.col("id").alias("a")), log)
    io.append_log(spark.range(2).select(F.col("id").alias("a")), log)
    assert io.read_log(spark, log, "a long").count() == 5
    assert io.read_artifacts(spark, str(tmp_path / "m.json")).first().sha256
