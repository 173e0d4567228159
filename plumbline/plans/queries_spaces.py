"""Queries of clear spaces and layout constraints; scenes of fifty pieces come from `part`."""

from pyspark.sql import functions as F

from plumbline.plans import spaces
from plumbline.registry import query
from plumbline.tables import table

_BOXES = """b AS (SELECT p_partkey // 50 AS scene, p_partkey AS id, p_partkey % 50 AS i, CASE WHEN p_partkey % 50 = 0 THEN 120.0 ELSE p_partkey * 37 % 60 * 4 END::DOUBLE AS x, CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE p_partkey * 53 % 80 * 4 END::DOUBLE AS y,
    CASE WHEN p_partkey % 50 = 0 THEN 30 + p_size % 8 WHEN p_partkey % 50 < 3 THEN 24 ELSE 4 + p_size % 5 * 2 END::DOUBLE AS width, CASE WHEN p_partkey % 50 = 0 THEN 4 WHEN p_partkey % 50 < 3 THEN 20 ELSE 4 + p_size % 3 * 2 END::DOUBLE AS depth FROM part)"""


def boxes(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    i = k % 50
    pick = lambda door, kiosk, other: F.when(i == 0, door).when(i < 3, kiosk).otherwise(other).cast("double")
    x, y = k * 37 % 60 * 4, k * 53 % 80 * 4
    return table(spark, sf_dir, "part").select(F.floor(k / 50).alias("scene"), k.alias("id"), i.alias("i"), pick(F.lit(120), x, x).alias("x"), pick(F.lit(0), y, y).alias("y"), pick(30 + z % 8, F.lit(24), 4 + z % 5 * 2).alias("width"), pick(F.lit(4), F.lit(20), 4 + z % 3 * 2).alias("depth"))


@query("door_spaces", f"""WITH {_BOXES}, d AS (SELECT d.scene, d.id, min(greatest(0, o.y - o.depth / 2 - d.y - d.depth / 2)) AS depth FROM b d LEFT JOIN b o ON o.scene = d.scene AND o.i > 0 AND abs(d.x - o.x) < (d.width + 18 + o.width) / 2 AND o.y + o.depth / 2 > d.y + d.depth / 2 WHERE d.i = 0 GROUP BY 1, 2)
    SELECT scene, id, CASE WHEN depth IS NULL OR depth >= 60 THEN 'passes' WHEN depth >= 48 THEN 'question' ELSE 'problem' END AS outcome, depth FROM d""")
def door_spaces(spark, sf_dir):
    """The free depth before doors."""
    b = boxes(spark, sf_dir)
    return spaces.door_clearances(b.filter("i = 0").drop("i"), b.filter("i > 0"))


@query("kiosk_spaces", f"""WITH {_BOXES}, w AS (SELECT unnest([0, 0, 1, 1, 2, 2, 3, 3]) AS face, unnest([0, 0, 1, 1, 0, 0, -1, -1]) AS dx, unnest([-1, -1, 0, 0, 1, 1, 0, 0]) AS dy, unnest([30.0, 48, 30, 48, 30, 48, 30, 48])::DOUBLE AS w, unnest([48.0, 30, 48, 30, 48, 30, 48, 30])::DOUBLE AS d),
    p AS (SELECT scene, id, face, x + dx * (width + w) / 2 AS px, y + dy * (depth + d) / 2 AS py, w, d FROM b, w WHERE i IN (1, 2)),
    f AS (SELECT scene, id, min(face) AS face FROM p WHERE px - w / 2 >= 0 AND py - d / 2 >= 0 AND px + w / 2 <= 240 AND py + d / 2 <= 320 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.scene = p.scene AND o.id <> p.id AND o.i > 0 AND abs(px - o.x) < (w + o.width) / 2 AND abs(py - o.y) < (d + o.depth) / 2) GROUP BY 1, 2)
    SELECT b.scene, b.id, CASE WHEN face IS NULL THEN 'problem' ELSE 'passes' END AS outcome, coalesce(face, 0)::INTEGER AS face FROM b LEFT JOIN f ON f.scene = b.scene AND f.id = b.id WHERE i IN (1, 2)""")
def kiosk_spaces(spark, sf_dir):
    """Clear floors at the faces of kiosks."""
    b = boxes(spark, sf_dir)
    return spaces.clear_floors(b.filter("i in (1, 2)").drop("i"), b.filter("i > 0"), (240.0, 320.0))


_LAYOUTS = """p AS (SELECT p_partkey // 50 AS scene, p_partkey AS id, p_partkey * 37 % 48 / 8.0::DOUBLE AS x, p_partkey * 53 % 64 / 8.0::DOUBLE AS y, 0.25::DOUBLE + p_size % 4 / 8.0::DOUBLE AS width, 0.25::DOUBLE + p_size % 3 / 8.0::DOUBLE AS depth, p_partkey % 4 <> 0 AS movable FROM part),
    bf AS (SELECT * FROM p WHERE id % 23 <> 5), af AS (SELECT scene, id, CASE WHEN id % 5 < 2 THEN x + (id % 3) * 0.75::DOUBLE ELSE x END AS x, y, CASE WHEN id % 11 = 0 THEN width + 0.125::DOUBLE ELSE width END AS width, depth FROM p WHERE id % 17 <> 0),
    j AS (SELECT coalesce(b.scene, a.scene) AS scene, coalesce(b.id, a.id) AS id, b.x, b.y, b.width, b.depth, movable, b.id IS NOT NULL AS was, a.id IS NOT NULL AS is_, a.x AS nx, a.y AS ny, a.width AS nw, a.depth AS nd, abs(a.x - b.x) AS move FROM bf b FULL JOIN af a ON a.id = b.id),
    m AS (SELECT * FROM j WHERE is_ AND (NOT was OR move > 1e-6)),
    c AS (SELECT m.*, i, k FROM m, range(-2, 16) a(i), range(-2, 20) b(k) WHERE abs((i + 0.5::DOUBLE) * 0.5 - nx) < nw / 2 AND abs((k + 0.5::DOUBLE) * 0.5 - ny) < nd / 2),
    sb AS (SELECT DISTINCT s.scene, s.id FROM bf s JOIN bf o ON o.scene = s.scene AND o.id <> s.id AND abs(s.x - o.x) < (s.width + o.width) / 2 AND abs(s.y - s.depth / 2 - 0.25 - o.y) < (0.5 + o.depth) / 2),
    sa AS (SELECT DISTINCT s.scene, s.id FROM af s JOIN af o ON o.scene = s.scene AND o.id <> s.id AND abs(s.x - o.x) < (s.width + o.width) / 2 AND abs(s.y - s.depth / 2 - 0.25 - o.y) < (0.5 + o.depth) / 2)"""


@query("changed_layouts", f"""WITH {_LAYOUTS} SELECT scene, id, 'removed' AS violation FROM j WHERE NOT is_ UNION ALL SELECT scene, id, 'locked_move' FROM j WHERE NOT movable AND move > 1e-6 UNION ALL SELECT scene, id, 'resized' FROM j WHERE abs(nw - width) > 1e-6
    UNION ALL SELECT scene, id, 'off_floor' FROM m WHERE nx - nw / 2 < 0 OR ny - nd / 2 < 0 OR nx + nw / 2 > 6 OR ny + nd / 2 > 8 UNION ALL SELECT scene, id, 'too_far' FROM j WHERE move > 1
    UNION ALL SELECT DISTINCT m.scene, m.id, 'collision' FROM m JOIN af o ON o.scene = m.scene AND o.id <> m.id AND abs(nx - o.x) < (nw + o.width) / 2 AND abs(ny - o.y) < (nd + o.depth) / 2
    UNION ALL SELECT scene, id, 'keep_clear' FROM m WHERE abs(nx - 3) < (nw + 1) / 2 AND abs(ny - 0.5) < (nd + 1) / 2 AND NOT coalesce(abs(x - 3) < (width + 1) / 2 AND abs(y - 0.5) < (depth + 1) / 2, false)
    UNION ALL SELECT DISTINCT scene, id, 'unseen_floor' FROM c WHERE i < 0 OR k < 0 OR i > 11 OR k > 15 OR (i * 5 + k * 3 + scene) % 7 = 0
    UNION ALL SELECT scene, id, 'lost_room' FROM sa WHERE (scene, id) NOT IN (SELECT scene, id FROM sb) AND id IN (SELECT id FROM bf)""")
def changed_layouts(spark, sf_dir):
    """All that a new layout of each scene may not do."""
    k, z = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        F.floor(k / 50).alias("scene"), k.alias("id"), (k * 37 % 48 / 8.0).alias("x"), (k * 53 % 64 / 8.0).alias("y"), (0.25 + z % 4 / 8.0).alias("width"), (0.25 + z % 3 / 8.0).alias("depth"), (k % 4 != 0).alias("movable")
    )
    i = F.col("id")
    after = p.filter(i % 17 != 0).select("scene", "id", F.when(i % 5 < 2, F.col("x") + i % 3 * 0.75).otherwise(F.col("x")).alias("x"), "y", F.when(i % 11 == 0, F.col("width") + 0.125).otherwise(F.col("width")).alias("width"), "depth")
    scenes = p.select("scene").distinct()
    zones = scenes.select("scene", F.lit("door").alias("zone"), F.lit(3.0).alias("x"), F.lit(0.5).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("depth"))
    cells = scenes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15))))
    seen = cells.filter((F.col("i") * 5 + F.col("j") * 3 + F.col("scene")) % 7 != 0)
    return spaces.layout_violations(p.filter(i % 23 != 5), after, zones, seen, (6.0, 8.0), 1.0, 0.5, 0.5)
