"""Publications as a whole or not at all, and meshes read a part at a time."""

import json
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from plumbline.sources import io, publish


def left(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_rows_are_published_once_whatever_their_order(spark, tmp_path, kind):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"r{i % 7}", None if i % 5 == 0 else i / 4) for i in range(200)], "id long, name string, x double")
    assert publish.published(spark, path).count() == 0
    name = publish.publish(rows, path, {"named": F.col("name").startswith("r")}, kind)
    files = left(path)
    assert publish.publish(rows.repartition(7).orderBy(F.desc("id")), path, kind=kind) == name
    assert left(path) == files and not any(f.startswith("staged") for f in files)
    back = publish.read_published(spark, path, name)
    assert back.schema == rows.schema and sorted(back.collect()) == sorted(rows.collect(), key=lambda r: r.id)
    other = publish.publish(rows.union(rows.limit(1)), path, kind=kind)
    assert other != name
    assert {(r.digest, r["rows"]) for r in publish.published(spark, path).collect()} == {(name, 200), (other, 201)}


def test_what_breaks_a_rule_or_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(50).withColumn("x", F.when(F.col("id") != 31, F.col("id")))
    with pytest.raises(publish.Refused, match="known.*1"):
        publish.publish(rows, path, {"known": F.col("x") >= 0, "small": F.col("id") < 50})

    def fails(batches):
        for batch in batches:
            if (batch["id"] == 40).any():
                raise RuntimeError("lost")
            yield batch

    with pytest.raises(PythonException, match="lost"):
        publish.publish(rows.mapInPandas(fails, rows.schema), path)
    assert left(path) == [] and publish.published(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, path, "0" * 64)


def test_meshes_are_read_a_part_at_a_time(spark, tmp_path):
    def mesh(parts):
        return {"version": 1, "parts": [{"id": f"p{i}", "transform": [float(i)] * 16, "vertices": [i / 2] * 30, "triangles": [0, 1, 2]} for i in range(parts)], "note": {"by": "a phone"}}

    for name, parts in (("a", 400), ("b", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps(mesh(parts), indent=1 if name == "b" else None))
    (tmp_path / "c.json").write_text('{"parts": []}')
    path = f"{tmp_path}/*.json"
    whole = io.read_mesh(spark, path).select("path", F.col("transform")[0].alias("t"), "vertices", "triangles")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        parts = io.read_mesh_parts(spark, path)
        # A file is no task: many read it, and the largest record is a part, whatever the size of the file.
        assert parts.rdd.getNumPartitions() >= 6
        longest = spark.read.text(f"{tmp_path}/a.json", lineSep="}").agg(F.max(F.length("value"))).first()[0]
        assert longest < 600 < os.path.getsize(tmp_path / "a.json") / 100
        assert sorted(map(repr, parts.select("path", F.col("transform")[0].alias("t"), "vertices", "triangles").collect())) == sorted(map(repr, whole.collect()))
        with pytest.raises(Exception, match="too many bytes"):
            io.read_mesh_parts(spark, path, most_bytes=100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
