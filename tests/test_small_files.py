"""Tables whose files are small but whose rows are many: no side of a join by cells is broadcast, and results stay."""

from pyspark.sql import functions as F

from plumbline.operators import footprints, layouts, rel, spatial
from plumbline.sources import io, queries_sources


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df):
    return "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_footprints_meet_by_shuffles(spark):
    k = F.col("id")
    boxes = spark.range(40).select("id", (k % 7 * 0.9).alias("cx"), (k % 5 * 0.8).alias("cy"), F.lit(0.5).alias("half_x"), F.lit(0.3).alias("half_y"), (k * 0.4).alias("angle"))
    assert shuffled(footprints.near_footprints(boxes, "id", 0.25))


def test_layout_collisions_meet_by_shuffles(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (2, 0.9, 0.0, 1.0, 1.0), (3, 1.0, 0.0, 1.0, 1.0), (4, 0.0, 0.0, 1.0, 1.0)]
    found = layouts.collisions(spark.createDataFrame(rows, "id long, x double, y double, width double, depth double"), 1.8)
    assert shuffled(found) and plan(found).count("SortMergeJoin") == 1
    assert {tuple(r) for r in found.collect()} == {(1, 2), (1, 4), (2, 3), (2, 4)}


def test_copies_of_a_place_make_few_pairs(spark, monkeypatch):
    made, real = [], spatial.within

    def spy(*args, **kwargs):
        made.append(real(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(spatial, "within", spy)
    k = F.col("k")
    points = spark.range(300).withColumnRenamed("id", "k").select("k", F.when(k % 3 == 0, 0.0).otherwise(k.cast("double")).alias("x"), F.lit("g").alias("g"))
    assert [tuple(r) for r in spatial.closest_pairs(points, "k", ["x"], "g", 50.0).collect()] == [("g", 0, 3, 0.0)]
    assert sum(df.count() for df in made) < 1000


def test_problems_at_one_place_meet_once(spark, monkeypatch):
    made, real = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    a = spark.range(60).select("id", F.lit("c").alias("kind"), F.when(F.col("id") < 50, 1.0).alias("x"), F.when(F.col("id") % 2 == 0, 3.0).alias("v"))
    left = rel.unmatched(a, a.filter("id % 2 = 0"), "id", "kind", ["x"], 0.5, "v", 1.0)
    assert shuffled(left) and {r.id for r in left.collect()} == set(range(1, 60, 2))
    assert made[0].count() == 2


def test_fixture_rooms_and_meshes_are_dealt_before_they_grow(spark):
    made = io.fixture_rooms(spark.range(30).coalesce(1).withColumnRenamed("id", "room"))
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and made.count() == 30 * len(io.SHOP)


def test_mesh_documents_are_made_after_rows_are_dealt(spark):
    asked = io.mesh_parts(queries_sources._meshes(spark, "/root/testdata/sf0.001")).filter("size(transform) = 16")
    assert "FileScan" not in plan(asked) and asked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
