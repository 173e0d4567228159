"""Queries of sources and sinks that need no files but the tables."""

from pyspark.sql import functions as F

from plumbline.operators import rel
from plumbline.registry import query
from plumbline.sources import io
from plumbline.tables import cut, dealt, table


@query("latest_export", """SELECT o_custkey, o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders JOIN (SELECT o_custkey AS c, max(o_orderdate) AS m FROM orders GROUP BY 1) ON c = o_custkey AND m = o_orderdate) GROUP BY ALL""")
def latest_export(spark, sf_dir):
    """S06."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderkey")
    return io.latest_export(orders, "o_custkey", "o_orderdate", "o_orderstatus").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("covered_surfaces", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount * 10 >= 0.70 - 1e-9 AND l_linenumber >= 2""")
def covered_surfaces(spark, sf_dir):
    """Observed share and viewpoints reach their floors."""
    return table(spark, sf_dir, "lineitem").filter((F.col("l_discount") * 10 >= 0.70 - 1e-9) & (F.col("l_linenumber") >= 2)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("room_documents", """SELECT n_regionkey AS room, kind, i AS "index", category, confidence, x, y, tx FROM (
    SELECT n_regionkey, 'object' AS kind, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_name AS category, CASE WHEN n_nationkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, n_regionkey * 1.5::DOUBLE AS x, 2.0::DOUBLE AS y, n_nationkey / 2 AS tx FROM nation
    UNION ALL SELECT r_regionkey, 'wall', 0, 'wall', 'medium', 4.0, 2.5, r_regionkey / 4 FROM region)""")
def room_documents(spark, sf_dir):
    """Nations as the objects of their region's room document, through the reader of rooms.

    Categories and confidences are text or objects of one key, extents objects or arrays, matrices flat or rows.
    """
    k = F.col("n_nationkey")
    flat = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) if i != 12 else k / 2 for i in range(16)])
    rows = F.array(*[F.array(*[F.lit(1.0 if r == c else 0.0) if (r, c) != (3, 0) else k / 2 for c in range(4)]) for r in range(4)])
    plain = F.to_json(F.struct(F.col("n_name").alias("category"), F.struct((F.col("n_regionkey") * 1.5).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("z")).alias("dimensions"), flat.alias("transform")))
    keyed = F.to_json(
        F.struct(F.create_map("n_name", F.create_map().cast("map<string,string>")).alias("category"), F.create_map(F.lit("high"), F.create_map().cast("map<string,string>")).alias("confidence"),
                 F.array(F.col("n_regionkey") * 1.5, F.lit(2.0), F.lit(1.0)).alias("dimensions"), rows.alias("transform"))
    )
    items = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), k.alias("k"), F.when(k % 3 == 0, keyed).otherwise(plain).alias("item"))
    by = items.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), ",").alias("objects"))
    wall = F.format_string('{"category":"wall","confidence":"medium","dimensions":{"x":4.0,"y":2.5,"z":0.1},"transform":[1,0,0,0,0,1,0,0,0,0,1,0,%s,0,0,1]}', (F.col("r_regionkey") / 4).cast("string"))
    docs = table(spark, sf_dir, "region").join(by, F.col("r") == F.col("r_regionkey"), "left").select(
        F.col("r_regionkey").cast("string").alias("path"), F.concat(F.lit('{"walls":['), wall, F.lit('],"objects":['), F.coalesce("objects", F.lit("")), F.lit("]}")).alias("doc")
    )
    found = io.rooms(docs)
    return found.select(F.col("path").cast("int").alias("room"), "kind", "index", "category", "confidence", "x", "y", F.col("matrix")[12].alias("tx"))


@query("oriented_boxes", """SELECT p_partkey, cos(a) AS m0, -sin(a) AS m1, x AS m3, sin(a) AS m4, cos(a) AS m5, y AS m7, z AS m11, p_size / 10 AS w, CASE WHEN p_partkey % 4 = 0 THEN 'hosted' ELSE 'rests_on' END AS relation
    FROM (SELECT *, radians(p_partkey % 360) AS a, p_partkey % 60 / 10 AS x, p_partkey % 80 / 10 AS y, p_size / 20 AS z FROM part)""")
def oriented_boxes(spark, sf_dir):
    """Boxes by centre, size and yaw as pieces with matrices."""
    k, s = F.col("p_partkey"), F.col("p_size")
    boxes = table(spark, sf_dir, "part").select("p_partkey", (k % 60 / 10).alias("cx"), (k % 80 / 10).alias("cy"), (s / 20).alias("cz"), (s / 10).alias("w"), (s / 10).alias("d"), (s / 10).alias("h"), (k % 360).alias("yaw"), F.when(k % 4 == 0, "hosted").alias("relation"))
    m = lambda i: F.col("matrix")[i].alias(f"m{i}")
    return io.boxes_as_pieces(boxes).select("p_partkey", *[m(i) for i in (0, 1, 3, 4, 5, 7, 11)], "w", "relation")


@query("fixture_rooms", """SELECT c_custkey AS room, count(*) AS pieces, sum(CASE WHEN kind = 'wall' THEN 1 ELSE 0 END)::BIGINT AS walls, round(sum(w), 6) AS widths FROM customer, (VALUES ('floor', 6.0), ('wall', 6.0), ('wall', 6.0), ('wall', 8.0), ('wall', 8.0), ('door', 0.9), ('counter', 2.4), ('table', 0.8), ('table', 0.8), ('chair', 0.45), ('chair', 0.45), ('shelf', 1.2)) t(kind, w) GROUP BY c_custkey""")
def fixture_rooms(spark, sf_dir):
    """The fixture room for every customer, its ids from the room and the piece's name."""
    made = io.fixture_rooms(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("room")))
    return made.groupBy("room").agg(F.count_distinct("id").alias("pieces"), F.count_if(F.col("kind") == "wall").alias("walls"), F.round(F.sum("w"), 6).alias("widths"))


def _meshes(spark, sf_dir):
    """A mesh document for each part: as many vertices as its size, and a fault of each kind in some."""
    k, n = F.col("p_partkey"), F.col("p_size") + 2
    vertices = F.transform(F.sequence(F.lit(0), (3 * n - 1).cast("int")), lambda i: (i % 7 + k % 5) / 4)
    flat = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) if i != 12 else (k % 3).cast("double") for i in range(16)])
    triangles = F.array(F.lit(0), F.lit(1), F.when(k % 17 == 3, n).otherwise(n - 1).cast("int"))
    one = F.struct(F.when(k % 17 == 1, F.slice(flat, 1, 12)).otherwise(flat).alias("transform"), F.when(k % 17 == 2, F.slice(vertices, 1, 4)).otherwise(vertices).alias("vertices"), triangles.alias("triangles"))
    doc = F.when(k % 17 == 0, F.lit('{"points": []}')).otherwise(F.to_json(F.struct(F.array(one, one).alias("parts"))))
    # Written, so that what is asked of documents is worked out after rows are dealt, not pushed below.
    rows = cut(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"))
    return rows.select(k.cast("string").alias("path"), doc.alias("doc"))


@query("mesh_points", """SELECT p_partkey AS k, 2 * (p_size + 2)::BIGINT AS n, round(2 * (SELECT sum((i * 3 % 7 + p_partkey % 5) / 4 + p_partkey % 3) FROM range(p_size + 2) t(i)), 6) AS x FROM part WHERE p_partkey % 17 NOT IN (0, 1, 2)""")
def mesh_points(spark, sf_dir):
    """Points of meshes, moved by their parts' transforms."""
    parts = io.mesh_parts(_meshes(spark, sf_dir)).filter("size(transform) = 16 and size(vertices) % 3 = 0")
    return io.points(parts).groupBy(F.col("path").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x"))


@query("judged_meshes", """SELECT p_partkey AS k, CASE p_partkey % 17 WHEN 0 THEN 'no parts' WHEN 1 THEN 'a transform isn''t 16 numbers' WHEN 2 THEN 'not threes of numbers' WHEN 3 THEN 'a triangle names no vertex' ELSE CASE WHEN 2 * (p_size + 2) > 80 THEN 'too many vertices' END END AS refused FROM part""")
def judged_meshes(spark, sf_dir):
    """Meshes by shape and size, refused with a reason."""
    return io.judged_meshes(_meshes(spark, sf_dir), 80, 1_000_000).select(F.col("path").cast("long").alias("k"), "refused")


@query("wanted_poses", """SELECT 'f' || e AS frame_id, e * 2.0::DOUBLE AS "timestamp" FROM (SELECT event_id AS e FROM events) WHERE e % 3 = 0 AND e % 7 <> 0 AND e % 5 <> 0""")
def wanted_poses(spark, sf_dir):
    """Poses of the wanted frames; unknown versions and short matrices are left out."""
    e = F.col("event_id")
    pose = F.struct(
        F.when(e % 7 == 0, 9).when(e % 2 == 0, 2).alias("version"), F.concat(F.lit("f"), e.cast("string")).alias("frame_id"), (e * 2.0).alias("timestamp"), F.array_repeat(F.lit(0.0), F.when(e % 5 == 0, 12).otherwise(16)).alias("transform")
    )
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list(pose)).alias("doc"))
    frames = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(F.concat(F.lit("f"), e.cast("string")).alias("frame_id"))
    return io.poses(docs, frames).select("frame_id", "timestamp")


@query("cache_digests", """SELECT user_id, sha256(string_agg(row, chr(10) ORDER BY row)) AS fingerprint FROM (SELECT user_id, concat_ws('|', event_id, sha256(event_type)) AS row FROM events) GROUP BY user_id""")
def cache_digests(spark, sf_dir):
    """The digest of all answers stored for a walk's photos, whatever their order."""
    row = F.concat_ws("|", "event_id", F.sha2("event_type", 256))
    return rel.fingerprint(table(spark, sf_dir, "events"), ["user_id"], row)


@query("manifest_hashes", """WITH r AS (SELECT n_nationkey, sha256(concat_ws('|', kind, item)) AS h FROM (SELECT n_nationkey, 'customer' AS kind, c_custkey AS item FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 'supplier', s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey))
    SELECT n_nationkey, count(*) AS rows, sha256(concat_ws('/', count(*), sum(('0x' || h[1:15])::BIGINT), sum(('0x' || h[16:30])::BIGINT))) AS fingerprint FROM r GROUP BY n_nationkey""")
def manifest_hashes(spark, sf_dir):
    """A manifest's rows, one for each requirement and item, and their hash."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("item"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("supplier"), "s_suppkey")
    both = table(spark, sf_dir, "nation").select("n_nationkey").join(c.union(s), "n_nationkey")
    return rel.digest(both, ["n_nationkey"], F.concat_ws("|", "kind", "item"))
