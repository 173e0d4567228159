"""Rows published as a whole or not at all: validated, staged, then named by their content.

A publication lies in `path`/published/<digest>; its manifest, `path`/manifests/<digest>.json, is written last and by
one rename, and readers see only what a manifest names. So a task or a driver that fails leaves nothing visible, and
publishing the same rows again changes nothing. Files are reached through Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """Rows that break a rule: nothing was written."""


def digest(rows: DataFrame) -> tuple[str, int]:
    """A name for the rows that depends on their content, number and schema, not on their order or partitions; and their number.

    Sums of two hashes of 64 bits a row, in decimals that don't overflow: no task holds more than its sums.
    """
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    sums = [F.sum(h.cast("decimal(20,0)")).alias(name) for name, h in (("a", F.xxhash64(whole)), ("b", F.xxhash64(whole, F.lit(1))))]
    found = rows.agg(F.count("*").alias("n"), *sums).first()
    named = json.dumps([found.n, str(found.a), str(found.b), rows.schema.simpleString()])
    return rows.sparkSession.range(1).select(F.sha2(F.lit(named), 256)).first()[0], found.n


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([path, *names]))


def publish(rows: DataFrame, path: str, rules: dict[str, Column] | None = None, kind: str = "parquet") -> str:
    """Publish `rows` below `path` and give their digest; `kind`: parquet, or json for a line a row.

    rules: conditions by name that every row must meet; a null is a breach. The first pass counts breaches and hashes
    what was staged, so what is published is what was judged even if the rows can't be made twice alike.
    """
    spark = rows.sparkSession
    fs, at = _files(spark, path)
    staged = f"staged/{uuid.uuid4().hex}"
    breach = lambda rule: F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)
    try:
        rows.write.format(kind).save(f"{path}/{staged}")
        kept = spark.read.schema(rows.schema).format(kind).load(f"{path}/{staged}")
        if rules:
            counts = kept.agg(*[F.sum(breach(rule)).alias(name) for name, rule in rules.items()]).first().asDict()
            broken = {name: n for name, n in counts.items() if n}
            if broken:
                raise Refused(f"rows break rules: {broken}")
        name, n = digest(kept)
        done = at("manifests", f"{name}.json")
        if not fs.exists(done):
            fs.mkdirs(at("published"))
            # Only the first of two writers of the same rows moves them; the other finds the manifest's folder taken.
            if not fs.exists(at("published", name)):
                fs.rename(at(staged), at("published", name))
            fs.mkdirs(at("manifests"))
            waiting = at("manifests", f".{uuid.uuid4().hex}")
            out = fs.create(waiting, False)
            out.write(json.dumps({"digest": name, "rows": n, "kind": kind, "schema": json.loads(rows.schema.json())}).encode())
            out.close()
            if not fs.rename(waiting, done):
                fs.delete(waiting, False)
        return name
    finally:
        fs.delete(at(staged), True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(digest, rows, kind) of what is published below `path`."""
    schema = "digest string, rows long, kind string"
    fs, at = _files(spark, path)
    if not fs.exists(at("manifests")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/manifests")


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one publication; a digest without a manifest is an error."""
    from pyspark.sql.types import StructType

    fs, at = _files(spark, path)
    if not fs.exists(at("manifests", f"{name}.json")):
        raise FileNotFoundError(f"{name} isn't published in {path}")
    manifest = json.loads(spark.read.text(f"{path}/manifests/{name}.json", wholetext=True).first()[0])
    return spark.read.schema(StructType.fromJson(manifest["schema"])).format(manifest["kind"]).load(f"{path}/published/{name}")
