"""Sources and sinks: rooms, meshes, poses, artifacts, logs and exports, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import dealt

#: Kinds of a room document's arrays: fixed values.
ROOM_ARRAYS = {"walls": "wall", "doors": "door", "windows": "window", "openings": "opening", "floors": "floor", "objects": "object"}
MESH = "array<struct<id: string, transform: array<double>, vertices: array<double>, triangles: array<int>>>"


def read_rooms(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of each room document: path, kind, index, id, category, confidence, x, y, z, matrix.

    Enums may be text or an object of one key, vectors arrays or objects, matrices flat or four rows. A missing
    confidence is low; a missing id follows from the path, kind and index. A document without elements is an error
    when it is read.
    """
    return rooms(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")))


def rooms(docs: DataFrame) -> DataFrame:
    """The elements of room documents (path, doc), as `read_rooms` gives them."""

    def of_kind(name: str, kind: str) -> Column:
        array = F.coalesce(F.from_json(F.get_json_object("doc", f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
        return F.transform(array, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("index"), x.alias("item")))

    items = F.concat(*[of_kind(name, kind) for name, kind in ROOM_ARRAYS.items()])
    checked = docs.withColumn("items", items).withColumn("items", F.when(F.size("items") > 0, F.col("items")).otherwise(F.raise_error(F.lit("a room without elements"))))
    rows = checked.select("path", F.explode("items").alias("e")).select("path", "e.*")
    text = lambda name: F.get_json_object("item", f"$.{name}")
    enum = lambda name: F.when(text(name).startswith("{"), F.json_object_keys(text(name))[0]).otherwise(text(name))
    flat = F.coalesce(F.from_json(text("transform"), "array<double>"), F.flatten(F.from_json(text("transform"), "array<array<double>>")))
    flat = F.when(text("transform").startswith("[["), F.flatten(F.from_json(text("transform"), "array<array<double>>"))).otherwise(flat)
    axis = lambda n, i: F.coalesce(F.get_json_object("item", f"$.dimensions.{n}"), F.get_json_object("item", f"$.dimensions[{i}]")).cast("double")
    own = F.concat_ws("-", F.lit("element"), "path", "kind", F.col("index").cast("string"))
    return rows.select(
        "path", "kind", "index", F.coalesce(text("identifier"), F.sha2(own, 256)).alias("id"), enum("category").alias("category"),
        F.coalesce(enum("confidence"), F.lit("low")).alias("confidence"), axis("x", 0).alias("x"), axis("y", 1).alias("y"), axis("z", 2).alias("z"), flat.alias("matrix"),
    )


def boxes_as_pieces(boxes: DataFrame) -> DataFrame:
    """Boxes (cx, cy, cz, w, d, h, yaw in degrees, relation) with a row-major matrix; without a relation they rest on the floor."""
    a = F.radians("yaw")
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(F.cos(a), -F.sin(a), zero, F.col("cx"), F.sin(a), F.cos(a), zero, F.col("cy"), zero, zero, one, F.col("cz"), zero, zero, zero, one)
    return boxes.withColumn("matrix", matrix).withColumn("relation", F.coalesce("relation", F.lit("rests_on")))


#: A small shop in metres, as (name, kind, x, y, w, d, h): fixed values.
SHOP = [
    ("floor", "floor", 3.0, 4.0, 6.0, 8.0, 0.02), ("south", "wall", 3.0, 0.0, 6.0, 0.04, 2.7), ("north", "wall", 3.0, 8.0, 6.0, 0.04, 2.7), ("west", "wall", 0.0, 4.0, 8.0, 0.04, 2.7),
    ("east", "wall", 6.0, 4.0, 8.0, 0.04, 2.7), ("entrance", "door", 3.0, 0.0, 0.9, 0.05, 2.1), ("till", "counter", 4.5, 6.0, 2.4, 0.7, 0.9), ("table-1", "table", 1.5, 2.0, 0.8, 0.8, 0.74),
    ("table-2", "table", 1.5, 5.0, 0.8, 0.8, 0.74), ("chair-1", "chair", 0.9, 2.0, 0.45, 0.45, 0.9), ("chair-2", "chair", 0.9, 5.0, 0.45, 0.45, 0.9), ("shelf", "shelf", 5.7, 3.0, 1.2, 0.4, 1.8),
]


def fixture_rooms(rooms_: DataFrame) -> DataFrame:
    """The same small shop for each row (room): room, id, name, kind, x, y, w, d, h; ids are the same at every run."""
    kind = "array<struct<name: string, kind: string, x: double, y: double, w: double, d: double, h: double>>"
    shop = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "kind", "x", "y", "w", "d", "h"), row, strict=True)]) for row in SHOP]).cast(kind)
    rows = dealt(rooms_.select("room"), "room").select("room", F.inline(shop))
    return rows.withColumn("id", F.sha2(F.concat_ws("/", F.lit("piece"), F.col("room").cast("string"), "name"), 256))


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """One row per mesh part: path, part, transform, vertices, triangles. Documents that aren't meshes give none."""
    return mesh_parts(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")))


def read_mesh_parts(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """path, id, transform, vertices and triangles of each part of mesh files, a part at a time.

    A part holds no object of its own, so each ends with the first closing brace: files are read as records that end
    with one, by as many tasks as they have blocks, and no task holds more than a record. What isn't a part is left out;
    a record of over `most_bytes` is an error. Ids must not hold braces.
    """
    record = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("record"))
    checked = F.when(F.octet_length("record") <= most_bytes, F.col("record")).otherwise(F.raise_error(F.lit("a mesh part of too many bytes")).cast("string"))
    part = F.from_json(F.concat(F.lit("{"), F.substring_index(checked, "{", -1), F.lit("}")), MESH[6:-1])
    return record.filter(F.contains("record", F.lit("{"))).select("path", part.alias("p")).filter("p.vertices is not null and p.triangles is not null").select("path", "p.*")


def mesh_parts(docs: DataFrame) -> DataFrame:
    """The parts of mesh documents (path, doc), as `read_mesh` gives them; parts are rows of their own from here on."""
    parsed = docs.select("path", F.from_json(F.get_json_object("doc", "$.parts"), MESH).alias("parts"))
    return parsed.select("path", F.posexplode("parts").alias("part", "p")).select("path", "part", "p.transform", "p.vertices", "p.triangles")


def judged_meshes(docs: DataFrame, most_vertices: int, most_bytes: int) -> DataFrame:
    """(path, vertices, triangles, refused) of mesh documents (path, doc): null, or the first reason to refuse one.

    Too many bytes; no parts; a transform that isn't 16 numbers; coordinates or corners that aren't threes, or
    missing; a triangle that names no vertex of its part; too many vertices.
    """
    parsed = docs.select("path", F.octet_length("doc").alias("bytes"), F.from_json(F.get_json_object("doc", "$.parts"), MESH).alias("parts"))
    total = lambda c: F.aggregate(F.coalesce("parts", F.array().cast(MESH)), F.lit(0).cast("long"), lambda n, p: n + F.floor(F.greatest(F.coalesce(F.size(p[c]), F.lit(0)), F.lit(0)) / 3))
    any_part = lambda f: F.coalesce(F.exists("parts", f), F.lit(False))
    holes = lambda p, c: F.coalesce(p[c].isNull() | (F.size(p[c]) % 3 != 0) | F.exists(p[c], lambda v: v.isNull()), F.lit(True))
    stray = lambda p: F.exists(p["triangles"], lambda t: (t < 0) | (t >= F.size(p["vertices"]) / 3))
    refused = (
        F.when(F.col("bytes") > most_bytes, "too many bytes")
        .when(F.col("parts").isNull() | (F.size("parts") == 0), "no parts")
        .when(any_part(lambda p: F.coalesce(F.size(p["transform"]) != 16, F.lit(True))), "a transform isn't 16 numbers")
        .when(any_part(lambda p: holes(p, "vertices") | holes(p, "triangles")), "not threes of numbers")
        .when(any_part(stray), "a triangle names no vertex")
        .when(F.col("vertices") > most_vertices, "too many vertices")
    )
    counted = parsed.withColumns({"vertices": total("vertices"), "triangles": total("triangles")})
    return counted.withColumn("refused", refused).select("path", "vertices", "triangles", "refused")


def points(parts: DataFrame) -> DataFrame:
    """One row per vertex, in room coordinates (column-major transforms applied)."""
    at = F.explode(F.sequence(F.lit(0), (F.size("vertices") / 3).cast("int") - 1)).alias("i")
    rows = parts.filter("size(vertices) >= 3").select("path", "part", "transform", "vertices", at)
    v = [F.get("vertices", F.col("i") * 3 + k) for k in range(3)]
    moved = [sum((F.col("transform")[4 * c + r] * v[c] for c in range(3)), F.col("transform")[12 + r]) for r in range(3)]
    return rows.select("path", "part", "i", *[m.alias(n) for m, n in zip(moved, "xyz", strict=True)])


POSE = "struct<version: int, frame_id: string, timestamp: double, transform: array<double>, intrinsics: array<double>>"


def read_poses(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """Camera poses of the wanted frames, in order of time."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    return poses(docs, frames).orderBy("timestamp", "frame_id")


def poses(docs: DataFrame, frames: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Poses of documents (doc), arrays of them: those of the wanted frames (frame_id) that can be projected.

    A pose needs a matrix of 16 numbers, and a version, 1 if it names none, that is known.
    """
    rows = docs.select(F.inline(F.from_json("doc", f"array<{POSE}>")))
    fit = F.coalesce("version", F.lit(1)).isin(*versions) & (F.size("transform") == 16)
    return rows.filter(fit).join(frames.select("frame_id").distinct(), "frame_id", "left_semi").select("frame_id", "timestamp", "transform", "intrinsics")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object per line, added to what is there."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON log by its schema; a missing one is empty, and so are blank lines."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, in order; Spark writes a file per range of it."""
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def latest_export(revisions: DataFrame, key: str, version: str, node: str) -> DataFrame:
    """The rows of each key's latest version, one per node: the first by what else they hold."""
    last = revisions.groupBy(key).agg(F.max(version).alias(version))
    whole = F.struct(*revisions.columns)
    return revisions.join(last, [key, version]).groupBy(key, node).agg(F.min(F.to_json(whole)).alias("json"))


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """Training rows as JSON lines, a folder for each split."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def write_results(rows: DataFrame, path: str, case: str, scorer: str, score: str, setting: str) -> None:
    """An evaluation's results below `path`: cases, their rows; means, a mean a scorer; grid, a mean a setting and scorer.

    Null scores are kept as rows and left out of means. All are JSON, a line a row.
    """
    mean = F.avg(score).alias("mean")
    rows.select(case, scorer, score, setting).write.mode("overwrite").json(f"{path}/cases")
    rows.groupBy(scorer).agg(mean, F.count(score).alias("n")).write.mode("overwrite").json(f"{path}/means")
    rows.groupBy(setting, scorer).agg(mean).write.mode("overwrite").json(f"{path}/grid")


COVERAGE = "array<struct<node_id: string, observed_fraction: double, viewpoint_count: int>>"


def coverage(docs: DataFrame, floor: float = 0.7, views: int = 2) -> DataFrame:
    """(path, node_id, observed_fraction, viewpoint_count, done) of coverage documents (path, doc); what isn't one gives no rows.

    done: so much was observed, from so many places; missing numbers aren't enough.
    """
    rows = docs.select("path", F.inline(F.from_json("doc", COVERAGE)))
    done = F.coalesce((F.col("observed_fraction") >= floor) & (F.col("viewpoint_count") >= views), F.lit(False))
    return rows.filter("node_id is not null").withColumn("done", done)


def floors_met(covered: DataFrame, floors: DataFrame, module: str) -> DataFrame:
    """(module, share, floor, met): the share of each module's done rows against its floor (module, floor); null met without a floor."""
    share = covered.groupBy(module).agg(F.avg(F.col("done").cast("double")).alias("share"))
    return share.join(floors, module, "full").select(module, "share", "floor", (F.coalesce("share", F.lit(0.0)) >= F.col("floor")).alias("met"))
