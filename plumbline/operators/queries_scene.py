"""Queries of scenes: trees of pieces, their predicates, poses, meshes, moves, markings and counts.

Scenes are made from `part`: fifty pieces each, so their number grows with the table and their size doesn't.
"""

from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import rel, scene, spatial
from plumbline.registry import query
from plumbline.tables import table

#: Fifty pieces a scene: a floor, four walls, fifteen pieces on the floor, and thirty on or in these.
PIECES = """SELECT scene, k AS id, i, CASE WHEN i < 5 THEN NULL WHEN i < 20 THEN k - i ELSE k - i + 5 + i % 15 END AS parent, CASE WHEN i < 5 THEN NULL WHEN k % 4 = 3 THEN 'inside' ELSE 'rests_on' END AS relation,
    p_type || ' ' || p_name AS label, i >= 5 AND k % 7 = 0 AS attached, i >= 1 AND k % 9 <> 0 AS touches, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS tipped, (k * 37 % 540) / 100 AS x, (k * 53 % 740) / 100 AS y,
    CASE WHEN i = 0 THEN 6.0::DOUBLE WHEN i < 5 THEN 4.0 ELSE (p_size + 5) / 25 END AS w, CASE WHEN i = 0 THEN 8.0::DOUBLE WHEN i < 5 THEN 0.04 ELSE (k % 13 + 2) / 10 END AS d,
    CASE WHEN i = 0 THEN 0.02::DOUBLE WHEN i < 5 THEN 2.7 ELSE (k % 11 + 3) / 10 END AS h FROM (SELECT *, p_partkey AS k, p_partkey // 50 AS scene, p_partkey % 50 AS i FROM part)"""


def pieces(spark, sf_dir):
    k = F.col("p_partkey")
    i = k % 50
    kind = lambda floor, wall, other: F.when(i == 0, F.lit(floor)).when(i < 5, F.lit(wall)).otherwise(other)
    tipped = (k % 3 == 1) & (i >= 5)
    zero, one = F.lit(0.0), F.lit(1.0)
    x, y = (k * 37 % 540) / 100, (k * 53 % 740) / 100
    level = F.array(one, zero, zero, x, zero, one, zero, y, zero, zero, one, zero, zero, zero, zero, one)
    on_side = F.array(one, zero, zero, x, zero, zero, -one, y, zero, one, zero, zero, zero, zero, zero, one)
    return table(spark, sf_dir, "part").select(
        F.floor(k / 50).alias("scene"), k.alias("id"), F.when(i < 5, F.lit(None)).when(i < 20, k - i).otherwise(k - i + 5 + i % 15).cast("long").alias("parent"),
        F.when(i < 5, F.lit(None)).when(k % 4 == 3, "inside").otherwise("rests_on").alias("relation"), F.concat_ws(" ", "p_type", "p_name").alias("label"),
        ((i >= 5) & (k % 7 == 0)).alias("attached"), ((i >= 1) & (k % 9 != 0)).alias("touches"), F.when(tipped, on_side).otherwise(level).alias("matrix"),
        kind(6.0, 4.0, (F.col("p_size") + 5) / 25).alias("w"), kind(8.0, 0.04, (k % 13 + 2) / 10).alias("d"), kind(0.02, 2.7, (k % 11 + 3) / 10).alias("h"),
    )


SIZED = f"""SELECT *, CASE WHEN tipped = 1 AND i >= 5 THEN d ELSE h END AS height, CASE WHEN tipped = 1 AND i >= 5 THEN greatest(w, h) ELSE greatest(w, d) END AS width, CASE WHEN tipped = 1 AND i >= 5 THEN least(w, h) ELSE least(w, d) END AS depth,
    least(w, d, h) <= 0.05 AND list_sort([w, d, h])[2] > 0.05 AND (list_sort([w, d, h])[2] * greatest(w, d, h) >= 1.0 OR greatest(w, d, h) >= 2.0) AS shell FROM ({PIECES})"""


@query("scene_predicates", f"""WITH s AS (SELECT *, shell AND height <= 0.05 AS flat, shell AND height > 0.05 AS upright, attached AS mounted, shell OR width * depth >= 1.0 AS hosts FROM ({SIZED})),
    f AS (SELECT s.*, s.parent IS NULL OR (coalesce(p.flat, false) AND s.relation = 'rests_on') AS on_floor FROM s LEFT JOIN s p ON p.scene = s.scene AND p.id = s.parent)
    SELECT id, round(width, 6) AS width, round(depth, 6) AS depth, round(height, 6) AS height, shell, flat, upright, mounted, hosts, on_floor, (upright OR (touches AND on_floor)) AND NOT mounted AS obstacle FROM f""")
def scene_predicates(spark, sf_dir):
    """Oriented extents, flat and upright sheets, mounted, able to host, standing on the floor, obstacles."""
    size = lambda c: F.round(c, 6).alias(c)
    return scene.predicates(pieces(spark, sf_dir)).select("id", *map(size, ("width", "depth", "height")), "shell", "flat", "upright", "mounted", "hosts", "on_floor", "obstacle")


@query("room_contents", f"""SELECT scene, count(*) FILTER (WHERE NOT shell) AS things, min(id) FILTER (WHERE NOT shell) AS first FROM ({SIZED}) GROUP BY scene""")
def room_contents(spark, sf_dir):
    """Everything in a room but its shell."""
    p = pieces(spark, sf_dir).filter(~X.sheet(F.col("w"), F.col("d"), F.col("h")))
    scenes = pieces(spark, sf_dir).select("scene").distinct()
    return scenes.join(p.groupBy("scene").agg(F.count("*").alias("things"), F.min("id").alias("first")), "scene", "left").select("scene", F.coalesce("things", F.lit(0)).alias("things"), "first")


@query("carried_things", f"""WITH RECURSIVE p AS ({PIECES}), d AS (SELECT id AS root, id AS node, 0 AS depth FROM p UNION ALL SELECT root, p.id, depth + 1 FROM d JOIN p ON p.parent = d.node),
    n AS (SELECT root, count(*) FILTER (WHERE depth > 0) AS carried, max(depth) AS deepest FROM d GROUP BY root), c AS (SELECT parent, count(*) FILTER (WHERE relation = 'rests_on') AS things_on, count(*) FILTER (WHERE relation = 'inside') AS things_inside FROM p WHERE parent IS NOT NULL GROUP BY parent)
    SELECT root AS id, coalesce(things_on, 0) AS things_on, coalesce(things_inside, 0) AS things_inside, carried, deepest FROM n LEFT JOIN c ON parent = root""")
def carried_things(spark, sf_dir):
    """What is on a piece, inside it, and carried by it at any depth."""
    p = pieces(spark, sf_dir)
    by = p.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count_if(F.col("relation") == "rests_on").alias("things_on"), F.count_if(F.col("relation") == "inside").alias("things_inside"))
    edges = p.filter("parent is not null").select("parent", F.col("id").alias("child"))
    below = rel.descendants(edges, p.select(F.col("id").alias("root"))).groupBy(F.col("root").alias("id")).agg(F.count_if(F.col("depth") > 0).alias("carried"), F.max("depth").alias("deepest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return below.join(by, "id", "left").select("id", zero("things_on"), zero("things_inside"), "carried", "deepest")


@query("carriers", f"""WITH RECURSIVE p AS ({PIECES}), a AS (SELECT id, parent AS carrier, 1 AS depth FROM p WHERE parent IS NOT NULL UNION ALL SELECT a.id, p.parent, depth + 1 FROM a JOIN p ON p.id = a.carrier WHERE p.parent IS NOT NULL)
    SELECT id, string_agg(carrier, ',' ORDER BY depth) AS chain FROM a GROUP BY id""")
def carriers(spark, sf_dir):
    """What carries a piece, nearest first."""
    edges = pieces(spark, sf_dir).filter("parent is not null").select("parent", F.col("id").alias("child"))
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"].cast("string")), ",")
    return rel.ancestors(edges).groupBy(F.col("node").alias("id")).agg(chain.alias("chain"))


@query("tree_cycles", """WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 50 = 10 AND p_size > 20 THEN p_partkey + 2 WHEN p_partkey % 50 IN (11, 12) THEN p_partkey - 1 ELSE p_partkey - p_partkey % 50 + (p_partkey % 50) // 2 END AS parent FROM part),
    r AS (SELECT k, k AS at FROM e UNION SELECT r.k, e.parent FROM r JOIN e ON e.k = r.at WHERE e.parent IS NOT NULL) SELECT k AS node FROM r JOIN e ON e.k = r.at GROUP BY r.k HAVING count(*) FILTER (WHERE e.parent IS NULL) = 0 AND bool_and(e.parent IN (SELECT k FROM e))""".replace("SELECT k AS node FROM r", "SELECT r.k AS node FROM r"))
def tree_cycles(spark, sf_dir):
    """Nodes on a cycle of parents, or below one."""
    k = F.col("p_partkey")
    i = k % 50
    parent = F.when(i == 0, F.lit(None)).when((i == 10) & (F.col("p_size") > 20), k + 2).when(i.isin(11, 12), k - 1).otherwise(k - i + F.floor(i / 2))
    return rel.cyclic(table(spark, sf_dir, "part").select(k.alias("child"), parent.cast("long").alias("parent")))


@query("z_up_poses", """SELECT p_partkey, s AS scale, s * 0.0 AS m1, x AS m3, 0 - z AS m7, y - 0.0 AS m11, x AS px, 0 - z AS py, y - 1.5 AS pz FROM (SELECT p_partkey, p_size / 10 AS s, p_partkey % 60 / 10 AS x, p_partkey % 7 / 10 AS y, p_partkey % 80 / 10 AS z FROM part)""")
def z_up_poses(spark, sf_dir):
    """poses and points of a capture with y up, in a frame with z up whose floor is at 0."""
    k, s = F.col("p_partkey"), F.col("p_size") / 10
    x, y, z, zero, one = k % 60 / 10, k % 7 / 10, k % 80 / 10, F.lit(0.0), F.lit(1.0)
    columns = F.array(s, zero, zero, zero, zero, s, zero, zero, zero, zero, s, zero, x, y, z, one)
    placed = table(spark, sf_dir, "part").select("p_partkey", scene.pose_to_z_up(columns).alias("m"), scene.into_room(x, y, z, F.lit(1.5)).alias("p"))
    return placed.select("p_partkey", F.col("m")[10].alias("scale"), F.col("m")[1].alias("m1"), F.col("m")[3].alias("m3"), F.col("m")[7].alias("m7"), F.col("m")[11].alias("m11"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.z").alias("pz"))


@query("joined_meshes", """SELECT k AS part, o AS "offset", o + k % 3 AS first, o + 2 + k % 4 AS last FROM (SELECT p_partkey AS k, coalesce(sum(3 + p_partkey % 4) OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM part)""")
def joined_meshes(spark, sf_dir):
    """Meshes of a scene as one, their triangles numbered over all vertices."""
    k = F.col("p_partkey")
    n = 3 + k % 4
    parts = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("scene"), k.alias("part"), F.array_repeat(F.lit(0.0), (3 * n).cast("int")).alias("vertices"), F.array(k % 3, n - 2, n - 1).alias("triangles"))
    return scene.joined_meshes(parts, ["scene"], ["part"]).select("part", "offset", F.col("triangles")[0].alias("first"), F.col("triangles")[2].alias("last"))


@query("strongest_moves", """SELECT l_partkey AS piece, l_orderkey AS answer, l_extendedprice AS reward, l_quantity AS dx FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1""")
def strongest_moves(spark, sf_dir):
    """Of several moves of a piece, the one with the highest reward."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("piece"), F.col("l_orderkey").alias("answer"), F.col("l_extendedprice").alias("reward"), F.col("l_quantity").alias("dx"), "l_linenumber", "l_suppkey")
    return scene.strongest_moves(rows, ["piece"], [F.col(c) for c in ("answer", "l_linenumber", "l_suppkey", "dx")]).select("piece", "answer", "reward", "dx")


@query("inspection_manifest", """SELECT word, p_partkey AS directive, pos FROM (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS w FROM part WHERE p_size > 40)) QUALIFY row_number() OVER (PARTITION BY word ORDER BY p_partkey, pos) = 1""")
def inspection_manifest(spark, sf_dir):
    """Each query of the directives that match, once, where it first occurs."""
    words = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("directive"), F.posexplode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("pos", "word"))
    return scene.once_only(words, "word", ["directive", "pos"])


@query("texts_on_pieces", """SELECT p_partkey AS id, coalesce(string_agg(l_returnflag || l_linestatus, ' | ' ORDER BY l_orderkey, l_returnflag || l_linestatus), NULL) AS texts, CASE WHEN count(l_orderkey) = 0 THEN 'none' WHEN min(l_discount * 20) >= 0.6 THEN 'measured' ELSE 'low' END AS quality
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def texts_on_pieces(spark, sf_dir):
    """What is written on a piece, and how sure that is."""
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("place"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_discount") * 20).alias("confidence"))
    return scene.texts_on(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), marks)


@query("asked_counts", f"""WITH t AS (SELECT label, count(*) AS n FROM ({PIECES}) GROUP BY label), a AS (SELECT unnest(['Ring', 'zeppelin', 'promo']) AS asked), b AS (SELECT asked, label, n, contains(lower(label), lower(asked)) AS fits FROM t, a)
    SELECT asked, label, n, bool_or(fits) OVER (PARTITION BY asked) AS found FROM b QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY asked)""")
def asked_counts(spark, sf_dir):
    """Q01: how many of what was asked for; the whole inventory where there is none."""
    asked = spark.createDataFrame([("Ring",), ("zeppelin",), ("promo",)], "asked string")
    return scene.counted(pieces(spark, sf_dir), asked)


PROBLEMS = "SELECT p_partkey AS id, 'c' || p_partkey % 5 AS chk, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 37 % 2000) / 10 END AS x, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 53 % 900) / 10 END AS y, CASE WHEN p_partkey % 6 <> 0 THEN p_size::DOUBLE END AS width FROM part"
IN_WINDOW = f"SELECT id, CASE WHEN id % 13 = 0 THEN 'c9' ELSE chk END AS chk, x + id % 3 * 0.2::DOUBLE AS x, y, width + id % 4 * 0.5::DOUBLE AS width FROM ({PROBLEMS}) WHERE id % 5 <> 2"
SAME = "a.chk = b.chk AND (a.x IS NULL) = (b.x IS NULL) AND (a.x IS NULL OR sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.25) AND (a.width IS NULL) = (b.width IS NULL) AND (a.width IS NULL OR abs(a.width - b.width) <= 1.0)"


@query("reproduced_problems", f"""WITH s AS ({PROBLEMS}), w AS ({IN_WINDOW}) SELECT 'lost' AS side, id FROM s a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE {SAME})
    UNION ALL SELECT 'invented', id FROM w a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {SAME})""")
def reproduced_problems(spark, sf_dir):
    """Problems of a scan that a window of it lost, and those that it invented."""
    k = F.col("p_partkey")
    placed = lambda c: F.when(k % 11 != 0, c)
    scan = table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("chk"), placed((k * 37 % 2000) / 10).alias("x"), placed((k * 53 % 900) / 10).alias("y"), F.when(k % 6 != 0, F.col("p_size").cast("double")).alias("width")
    )
    chk = F.when(F.col("id") % 13 == 0, "c9").otherwise(F.col("chk"))
    window = scan.filter("id % 5 <> 2").select("id", chk.alias("chk"), (F.col("x") + F.col("id") % 3 * 0.2).alias("x"), "y", (F.col("width") + F.col("id") % 4 * 0.5).alias("width"))
    lost, invented = (rel.unmatched(a, b, "id", "chk", ["x", "y"], 0.25, "width", 1.0) for a, b in ((scan, window), (window, scan)))
    return lost.select(F.lit("lost").alias("side"), "id").union(invented.select(F.lit("invented"), "id"))


PLACED = f"SELECT *, CASE WHEN i = 0 THEN 0.0 WHEN i < 5 THEN 1.35 ELSE (k % 6) / 4 END AS z, k AS id2 FROM (SELECT *, id AS k FROM ({SIZED}))"


def _placed(spark, sf_dir):
    k = F.col("id")
    z = F.when(k % 50 == 0, 0.0).when(k % 50 < 5, 1.35).otherwise(k % 6 / 4)
    return pieces(spark, sf_dir).withColumns({"x": F.col("matrix")[3], "y": F.col("matrix")[7], "z": z})


@query("nearest_walls", f"""WITH s AS ({PIECES}), w AS (SELECT scene, id AS wall, x - 2 AS x1, y AS y1, x + 2 AS x2, y + 1 AS y2 FROM s WHERE i BETWEEN 1 AND 4), p AS (SELECT scene, id, x, y FROM s WHERE i >= 5),
    t AS (SELECT p.id, wall, greatest(0, least(1, ((x - x1) * 4 + (y - y1) * 1) / 17)) AS t, x, y, x1, y1 FROM p JOIN w USING (scene)), d AS (SELECT id, wall, sqrt((x - x1 - t * 4) ** 2 + (y - y1 - t) ** 2) AS d FROM t)
    SELECT id, wall, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, wall) = 1""")
def nearest_walls(spark, sf_dir):
    """Each piece's nearest wall, by projection held within the wall's ends."""
    p = _placed(spark, sf_dir)
    walls = p.filter("id % 50 between 1 and 4").select("scene", F.col("id").alias("wall"), (F.col("x") - 2).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 2).alias("x2"), (F.col("y") + 1).alias("y2"))
    found = spatial.nearest_segments(p.filter("id % 50 >= 5").select("scene", "id", "x", "y"), walls, "id", "scene", "wall")
    return found.withColumn("distance", F.round("distance", 6))


@query("best_supports", f"""WITH s AS (SELECT scene, id, x, y, width, depth, z - height / 2 AS bottom, z + height / 2 AS top, shell FROM ({PLACED})), n AS (SELECT a.id, b.id AS support, a.bottom - b.top AS gap, b.top AS t FROM s a JOIN s b ON a.scene = b.scene AND a.id <> b.id AND NOT b.shell
    AND abs(a.x - b.x) <= b.width / 2 AND abs(a.y - b.y) <= b.depth / 2 AND abs(a.bottom - b.top) <= 0.3), r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(abs(gap), 9), -t, support) = 1)
    SELECT s.id, support, round(gap, 6) + 0.0 AS gap FROM s LEFT JOIN r USING (id)""")
def best_supports(spark, sf_dir):
    """What each piece rests on."""
    p = scene.predicates(_placed(spark, sf_dir)).withColumns({"bottom": F.col("z") - F.col("height") / 2, "top": F.col("z") + F.col("height") / 2})
    return spatial.best_support(p, "scene", 0.3).select("id", "support", (F.round("gap", 6) + F.lit(0.0)).alias("gap"))


@query("measured_pieces", f"""WITH s AS (SELECT *, shell AND height <= 0.05 AS flat, shell AND height > 0.05 AS upright FROM ({PLACED})), w AS (SELECT scene, max(z + height / 2) AS t FROM s WHERE upright GROUP BY scene)
    SELECT s.id, round(CASE WHEN s.parent IS NULL OR (coalesce(p.flat, false) AND s.relation = 'rests_on') THEN s.width * s.depth / 0.0254::DOUBLE ** 2 END, 4) AS floor_area, round(greatest(0, w.t - s.z - s.height / 2) / 0.0254::DOUBLE, 4) AS clearance
    FROM s LEFT JOIN s p ON p.scene = s.scene AND p.id = s.parent LEFT JOIN w ON w.scene = s.scene""")
def measured_pieces(spark, sf_dir):
    """Floor areas, and clearances below the walls' tops."""
    found = scene.measured(scene.predicates(_placed(spark, sf_dir)))
    return found.select("id", F.round("floor_area", 4).alias("floor_area"), F.round("clearance", 4).alias("clearance"))


@query("ways_between", f"""WITH s AS ({PLACED}) SELECT a.id, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 6) AS distance, round((a.x + b.x) / 2, 6) AS middle_x, CASE WHEN sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) <= 0.01 THEN 'here' WHEN abs(b.x - a.x) >= abs(b.y - a.y)
    THEN CASE WHEN b.x > a.x THEN 'right' ELSE 'left' END WHEN b.y > a.y THEN 'front' ELSE 'behind' END AS way FROM s a JOIN s b ON b.id = a.parent""")
def ways_between(spark, sf_dir):
    """From each piece to what carries it: distance, the point between, and the way."""
    p = _placed(spark, sf_dir)
    carrier = p.filter("parent is not null").select("id", F.col("parent").alias("c")).join(p.select(F.col("id").alias("c"), "x", "y", "z"), "c")
    return spatial.directions(p, carrier, "id").select("id", F.round("distance", 6).alias("distance"), F.round("middle.x", 6).alias("middle_x"), "way")


@query("moved_pieces", f"""WITH RECURSIVE s AS ({PIECES}), a AS (SELECT id, id AS at, 0 AS depth FROM s UNION ALL SELECT a.id, s.parent, depth + 1 FROM a JOIN s ON s.id = a.at WHERE s.parent IS NOT NULL), m AS (SELECT a.id, a.at, depth FROM a WHERE a.at % 50 BETWEEN 5 AND 24 AND a.at % 3 = 0),
    n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1) SELECT s.id, round(x + CASE WHEN n."at" IS NULL THEN 0 ELSE (n."at" % 4) / 2 END, 6) AS x, round(y + CASE WHEN n."at" IS NULL THEN 0 ELSE 0.25 END, 6) AS y, CASE WHEN n."at" <> s.id THEN n."at" END AS carried_by FROM s LEFT JOIN n ON n.id = s.id""")
def moved_pieces(spark, sf_dir):
    """Moves of pieces, with what they carry."""
    p = _placed(spark, sf_dir)
    moves = p.filter("id % 50 between 5 and 24 and id % 3 = 0").select("id", (F.col("id") % 4 / 2).alias("dx"), F.lit(0.25).alias("dy"))
    return scene.moved(p, moves).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "carried_by")
