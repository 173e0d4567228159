"""Queries of the checks measured from pieces; scenes of fifty pieces come from `part`."""

from pyspark.sql import functions as F

from plumbline.plans import checks
from plumbline.registry import query
from plumbline.tables import table

#: Each role's place in a scene, with its x, y, width, depth, bottom and top over i (place), m (scene) and z (p_size).
_ROLES = {
    "1": ("wall", "120.0", "0.0", "240.0", "4.0", "0.0", "106.0"), "2": ("wall", "120.0", "320.0", "240.0", "4.0", "0.0", "106.0"),
    "3": ("wall", "0.0", "160.0", "4.0", "320.0", "0.0", "106.0"), "4": ("wall", "240.0", "160.0", "4.0", "320.0", "0.0", "106.0"),
    "5": ("toilet", "if(m % 5 = 0, 120.0, 16.0 + z % 8)", "300.0", "15.0", "28.0", "0.0", "17.0"), "6": ("if(m % 4 = 1, 'chair', 'bar')", "3.0", "296.0", "2.0", "36.0 + z % 12", "30.0 + z % 5", "31.5 + z % 5"),
    "7": ("bar", "20.0", "317.0", "30.0 + z % 10", "2.0", "32.0", "32.0 + z % 6"), "8": ("sink", "60.0", "310.0", "20.0", "18.0", "25.0", "30.0 + z % 7"),
    "9": ("mirror", "if(z % 6 = 0, 150.0, 60.0)", "318.0", "18.0", "1.0", "36.0 + z % 8", "70.0"), "10": ("counter", "180.0", "100.0", "60.0", "24.0", "0.0", "35.0 + z % 8"),
    "11": ("if(m % 3 <> 0, 'lowered', 'chair')", "230.0", "100.0", "36.0", "24.0", "0.0", "30.0 + z % 8"), "12": ("reader", "if(z % 2 = 0, 230.0, if(z % 7 = 0, 20.0, 180.0))", "100.0", "4.0", "4.0", "36.0", "40.0"),
    "19": ("mounted", "if(z % 9 = 0, 100.0, 238.0 - (2.0 + z % 6) / 2)", "160.0", "2.0 + z % 6", "20.0", "20.0 + z", "32.0 + z"), "20": ("control", "3.0", "100.0", "2.0", "4.0", "10.0 + z", "14.0 + z + z % 4 * 6"),
    "21": ("ramp", "120.0", "60.0", "34.0 + z % 6", "100.0", "0.0", "10.0"), "22": ("landing", "120.0", "10.0 - z % 9 / 2.0", "60.0", "56.0 + z % 9", "0.0", "1.0"), "23": ("if(z % 8 = 0, 'chair', 'landing')", "120.0", "138.0 + z % 9 / 2.0", "60.0", "56.0 + z % 9", "0.0", "1.0"),
    "24": ("rail", "102.0", "60.0", "2.0", "100.0", "0.0", "32.0 + z % 8"), "25": ("if(z % 5 = 0, 'chair', 'rail')", "138.0", "60.0", "2.0", "100.0", "0.0", "31.0 + z % 8"), "26": ("door", "60.0", "0.0", "29.0 + z % 6", "5.0", "0.0", "80.0"),
}
_FIELDS = ("role", "x", "y", "width", "depth", "bottom", "top")


def _cases(spark: bool) -> list[str]:
    out = []
    for n, name in enumerate(_FIELDS):
        whens = " ".join(f"WHEN i = {i} THEN {(repr(f[n]) if n == 0 and not f[n].startswith('if(') else f[n]) if n == 0 else f'cast({f[n]} as double)'}" for i, f in _ROLES.items())
        rest = ("'table'", "40.0 * (i - 12)", "200.0", "30.0", "30.0", "0.0", "26.0 + z * i % 11")[n]
        other = ("'chair'", "100.0", "250.0", "18.0", "18.0", "0.0", "34.0")[n]
        kind = "{}" if n == 0 else "cast({} as double)"
        out.append(f"CASE {whens} WHEN i BETWEEN 13 AND 18 THEN {kind.format(rest)} ELSE {kind.format(other)} END AS {name}")
    return out


_BASE = f"SELECT scene, id, {', '.join(_cases(True))}, cast(100.0 + z * 4 AS DOUBLE) AS run, cast(z % 20 AS DOUBLE) AS rise FROM"
PIECES = f"p AS ({_BASE} (SELECT p_partkey // 50 AS scene, p_partkey AS id, p_partkey % 50 AS i, p_partkey // 50 AS m, p_size AS z FROM part))"


def pieces(spark, sf_dir):
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("scene"), k.alias("id"), (k % 50).alias("i"), F.floor(k / 50).alias("m"), F.col("p_size").alias("z"))
    return base.selectExpr("scene", "id", *_cases(True), "cast(100.0 + z * 4 AS DOUBLE) AS run", "cast(z % 20 AS DOUBLE) AS rise")


def _judge(value: str, low: float | None = None, high: float | None = None) -> str:
    fits = " AND ".join([*([f"{value} >= {low} - 1e-6"] if low is not None else []), *([f"{value} <= {high} + 1e-6"] if high is not None else [])])
    return f"CASE WHEN {value} IS NULL THEN 'question' WHEN {fits} THEN 'passes' ELSE 'problem' END"


_ALL = f"""{PIECES}, lw AS (SELECT DISTINCT scene FROM p WHERE role = 'lowered'), t AS (SELECT * FROM p WHERE role = 'toilet'), w AS (SELECT * FROM p WHERE role = 'wall'), o AS (
    SELECT scene, 'service_counter_height' AS "check", id, {_judge('top', high=36)} AS outcome, top AS measured FROM p WHERE role = 'lowered' OR (role = 'counter' AND scene NOT IN (SELECT scene FROM lw))
    UNION ALL SELECT scene, 'point_of_sale_height', id, {_judge('s', high=36)}, s FROM (SELECT r.scene, r.id, (SELECT arg_min(s.top, (abs(r.bottom - s.top), -s.top, s.id)) FROM p s WHERE s.scene = r.scene AND s.role IN ('counter', 'lowered', 'table') AND abs(r.x - s.x) <= s.width / 2 AND abs(r.y - s.y) <= s.depth / 2 AND abs(r.bottom - s.top) <= 8) AS s FROM p r WHERE r.role = 'reader' AND r.scene IN (SELECT scene FROM lw))
    UNION ALL SELECT scene, 'water_closet_location', id, {_judge('a', 16, 18)}, a FROM (SELECT t.scene, t.id, (SELECT min(abs(t.x - w.x) - w.width / 2) FROM w WHERE w.scene = t.scene AND w.depth >= w.width AND abs(t.y - w.y) <= w.depth / 2 AND abs(t.x - w.x) - w.width / 2 BETWEEN 0 AND 36) AS a FROM t)
    UNION ALL SELECT scene, 'grab_bar_lengths', id, CASE WHEN s IS NULL OR r IS NULL THEN 'question' WHEN s >= 42 - 1e-6 AND r >= 36 - 1e-6 THEN 'passes' ELSE 'problem' END, CASE WHEN s IS NOT NULL AND r IS NOT NULL THEN least(s - 42, r - 36) END
      FROM (SELECT t.scene, t.id, max(CASE WHEN b.depth >= b.width THEN b.depth END) AS s, max(CASE WHEN b.depth < b.width THEN b.width END) AS r FROM t LEFT JOIN p b ON b.scene = t.scene AND b.role = 'bar' AND abs(t.x - b.x) - (t.width + b.width) / 2 <= 24 AND abs(t.y - b.y) - (t.depth + b.depth) / 2 <= 24 GROUP BY 1, 2)
    UNION ALL SELECT scene, 'grab_bar_height', id, {_judge('top', 33, 36)}, top FROM p WHERE role = 'bar'
    UNION ALL SELECT scene, 'lavatory_rim', id, {_judge('top', high=34)}, top FROM p WHERE role = 'sink'
    UNION ALL SELECT scene, 'lavatory_mirror', id, {_judge('bottom', high=40)}, bottom FROM p m WHERE role = 'mirror' AND EXISTS (SELECT 1 FROM p s WHERE s.scene = m.scene AND s.role = 'sink' AND abs(m.x - s.x) <= (m.width + s.width) / 2 AND abs(m.y - s.y) <= (m.depth + s.depth) / 2 + 12 AND m.bottom >= s.top - 1e-6)
    UNION ALL SELECT scene, 'door_clear_width', id, 'question', greatest(width, depth) FROM p WHERE role = 'door'
    UNION ALL SELECT scene, 'protruding_objects', id, {_judge('v', high=4)}, v FROM (SELECT h.scene, h.id, (SELECT arg_min(abs(h.x - w.x) + h.width / 2 - w.width / 2, (abs(h.x - w.x) - w.width / 2, w.id)) FROM w WHERE w.scene = h.scene AND w.width <= w.depth AND abs(h.y - w.y) <= w.depth / 2 AND abs(h.x - w.x) - h.width / 2 - w.width / 2 <= 2) AS v FROM p h WHERE role = 'mounted' AND bottom > 27 AND bottom <= 80)
    UNION ALL SELECT scene, 'dining_surface_height', min(id), CASE WHEN count(*) FILTER (WHERE top BETWEEN 28.5 - 1e-6 AND 33.5 + 1e-6) >= greatest(1, ceil(count(*) * 0.05)) THEN 'passes' WHEN count(*) FILTER (WHERE top BETWEEN 27.5 - 1e-6 AND 34.5 + 1e-6) >= greatest(1, ceil(count(*) * 0.05)) THEN 'question' ELSE 'problem' END, count(*) FILTER (WHERE top BETWEEN 28.5 - 1e-6 AND 33.5 + 1e-6) FROM p WHERE role = 'table' GROUP BY scene
    UNION ALL SELECT scene, 'reach_range', id, CASE WHEN bottom >= 15 - 1e-6 AND top <= 48 + 1e-6 THEN 'passes' WHEN top < 15 - 1e-6 OR bottom > 48 + 1e-6 THEN 'problem' ELSE 'question' END, top FROM p WHERE role = 'control'),
    r AS (SELECT r.scene, r.id, r.run, r.rise, r.width, count(*) FILTER (WHERE q.role = 'landing') AS n, min(q.depth) FILTER (WHERE q.role = 'landing') AS shortest, count(*) FILTER (WHERE q.role = 'rail') AS rails, arg_max(q.top, (greatest(34 - q.top, q.top - 38), -q.id)) FILTER (WHERE q.role = 'rail') AS worst
      FROM p r LEFT JOIN p q ON q.scene = r.scene AND q.role IN ('landing', 'rail') AND abs(r.x - q.x) - (r.width + q.width) / 2 <= 6 AND abs(r.y - q.y) - (r.depth + q.depth) / 2 <= 6 WHERE r.role = 'ramp' GROUP BY ALL),
    a AS (SELECT * FROM o UNION ALL SELECT scene, 'ramp_slope', id, CASE WHEN rise = 0 THEN 'passes' ELSE {_judge('run / rise', 12)} END, CASE WHEN rise <> 0 THEN run / rise END FROM r UNION ALL SELECT scene, 'ramp_rise', id, {_judge('rise', high=30)}, rise FROM r
      UNION ALL SELECT scene, 'ramp_width', id, {_judge('width', 36)}, width FROM r UNION ALL SELECT scene, 'ramp_landings', id, CASE WHEN n < 2 THEN 'question' ELSE {_judge('shortest', 60)} END, shortest FROM r
      UNION ALL SELECT scene, 'ramp_handrails', id, CASE WHEN rise <= 6 OR rails >= 2 THEN 'passes' ELSE 'problem' END, rails FROM r UNION ALL SELECT scene, 'ramp_rail_height', id, {_judge('worst', 34, 38)}, worst FROM r WHERE worst IS NOT NULL)"""


@query("measured_checks", f"""WITH {_ALL} SELECT scene, "check", id, outcome, round(measured, 6) AS measured FROM a""")
def measured_checks(spark, sf_dir):
    """What each check observes in the pieces of a scene."""
    return checks.all_checks(pieces(spark, sf_dir)).withColumn("measured", F.round("measured", 6))


_RULES = ("service_counter_height", "point_of_sale_height", "water_closet_location", "grab_bar_lengths", "lavatory_rim", "reach_range", "ramp_slope", "exit_path")


@query("room_compliance", f"""WITH {_ALL}, l AS (SELECT unnest({list(_RULES)}) AS rule), s AS (SELECT scene, "check" AS rule, max(CASE outcome WHEN 'problem' THEN 2 WHEN 'question' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM a GROUP BY 1, 2),
    q AS (SELECT DISTINCT scene, rule, rule <> 'reach_range' AS enabled FROM p, l)
    SELECT scene, rule, coalesce(enabled, false) AS enabled, CASE WHEN enabled IS NULL THEN 'not listed' WHEN NOT enabled THEN 'off' WHEN worst IS NULL THEN 'not evaluated' ELSE ['passes', 'question', 'problem'][worst + 1] END AS outcome, coalesce(n, 0)::BIGINT AS n FROM q FULL JOIN s USING (scene, rule)""")
def room_compliance(spark, sf_dir):
    """Every rule of a pack for every scene, with what its checks observed there."""
    p = pieces(spark, sf_dir)
    rules = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in _RULES])).alias("rule")).withColumn("enabled", F.col("rule") != "reach_range")
    return checks.compliance(rules, p.select("scene"), checks.all_checks(p))


@query("gravity_directions", """SELECT vec_id, round(-x / n, 6) AS x, round(-y / n, 6) AS y, round(-z / n, 6) AS z FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, sqrt(x * x + y * y + z * z) AS n FROM embeddings)""")
def gravity_directions(spark, sf_dir):
    """The way down in each frame, from its upward axis."""
    up = [F.col("embedding")[i].cast("double") for i in range(3)]
    v = table(spark, sf_dir, "embeddings").select("vec_id", checks.down(up).alias("d"))
    return v.select("vec_id", *[F.round(F.col("d")[i], 6).alias(c) for i, c in enumerate("xyz")])


@query("arrangement_shapes", f"""WITH {PIECES}, g AS (SELECT id // 50 AS scene, 's' || id % 50 % 11 AS subject, id, id % 50 // 11 AS j, id % 50 % 11 AS f, id // 50 AS m FROM (SELECT p_partkey AS id FROM part)),
    s AS (SELECT scene, subject, id, (CASE f % 4 WHEN 0 THEN 20 + j % 2 * 60 WHEN 1 THEN 10 + j * 50 WHEN 2 THEN 60 + (j * 7 + m) % 5 * 9 ELSE j * 53 % 220 + 10 END)::DOUBLE AS x, (CASE f % 4 WHEN 0 THEN 30 + j // 2 * 70 WHEN 1 THEN 8 + m % 3 * j * 40 WHEN 2 THEN 90 + (j * 3 + m) % 5 * 11 ELSE j * 97 % 300 + 10 END)::DOUBLE AS y, 5.0::DOUBLE AS width, 4.0::DOUBLE AS depth FROM g),
    r AS (SELECT scene, subject, sum(new) OVER (PARTITION BY scene, subject ORDER BY y, id) AS g, y AS v FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY scene, subject ORDER BY y, id) > 7.5 THEN 1 ELSE 0 END AS new FROM s)),
    c AS (SELECT scene, subject, sum(new) OVER (PARTITION BY scene, subject ORDER BY x, id) AS g, x AS v FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY scene, subject ORDER BY x, id) > 7.5 THEN 1 ELSE 0 END AS new FROM s)),
    rr AS (SELECT scene, subject, count(*) AS rows, (max(a) - min(a)) / nullif(count(*) - 1, 0) AS row_spacing, max(h) - min(l) AS e FROM (SELECT scene, subject, g, avg(v) AS a, min(v) AS l, max(v) AS h FROM r GROUP BY ALL) GROUP BY 1, 2),
    cc AS (SELECT scene, subject, count(*) AS columns, (max(a) - min(a)) / nullif(count(*) - 1, 0) AS column_spacing, max(h) - min(l) AS e FROM (SELECT scene, subject, g, avg(v) AS a, min(v) AS l, max(v) AS h FROM c GROUP BY ALL) GROUP BY 1, 2),
    w AS (SELECT * FROM p WHERE role = 'wall'), room AS (SELECT scene, max(x) - min(x) AS wide, max(y) - min(y) AS long FROM w GROUP BY scene),
    h AS (SELECT scene, subject, count(*) AS n, count(*) FILTER (WHERE (SELECT min(sqrt(greatest(0, abs(s.x - w.x) - (s.width + w.width) / 2) ** 2 + greatest(0, abs(s.y - w.y) - (s.depth + w.depth) / 2) ** 2)) FROM w WHERE w.scene = s.scene) <= 24) AS hug FROM s GROUP BY 1, 2)
    SELECT scene, subject, n, rows, columns, round(row_spacing, 6) AS row_spacing, round(column_spacing, 6) AS column_spacing, CASE WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'pair' WHEN rows = 1 OR columns = 1 THEN 'row' WHEN rows * columns = n AND least(rows, columns) = 2 AND n = 4 THEN 'two_rows' WHEN rows * columns = n THEN 'grid'
      WHEN hug >= n - 1 THEN 'ring' WHEN greatest(coalesce(rr.e / nullif(long, 0), 0), coalesce(cc.e / nullif(wide, 0), 0)) <= 0.35 THEN 'cluster' ELSE 'spread' END AS shape FROM h JOIN rr USING (scene, subject) JOIN cc USING (scene, subject) LEFT JOIN room USING (scene)""")
def arrangement_shapes(spark, sf_dir):
    """Q05: the shapes in which the pieces of each kind of a room stand."""
    i, m = F.col("p_partkey") % 50, F.floor(F.col("p_partkey") / 50)
    j, f = F.floor(i / 11), i % 11 % 4
    x = F.when(f == 0, 20 + j % 2 * 60).when(f == 1, 10 + j * 50).when(f == 2, 60 + (j * 7 + m) % 5 * 9).otherwise(j * 53 % 220 + 10)
    y = F.when(f == 0, 30 + F.floor(j / 2) * 70).when(f == 1, 8 + m % 3 * j * 40).when(f == 2, 90 + (j * 3 + m) % 5 * 11).otherwise(j * 97 % 300 + 10)
    s = table(spark, sf_dir, "part").select(m.alias("scene"), F.concat(F.lit("s"), i % 11).alias("subject"), F.col("p_partkey").alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(5.0).alias("width"), F.lit(4.0).alias("depth"))
    found = checks.arrangements(s, pieces(spark, sf_dir).filter("role = 'wall'"))
    return found.withColumns({c: F.round(c, 6) for c in ("row_spacing", "column_spacing")})
