"""Queries of exact footprints and segments."""

from pyspark.sql import functions as F

from plumbline.operators import footprints
from plumbline.registry import query
from plumbline.tables import table

_BOXES = """b AS (SELECT p_partkey AS id, (p_partkey // 40) * 2.5::DOUBLE AS cx, (p_partkey % 40) * 1.5::DOUBLE AS cy, 0.3::DOUBLE + p_size / 40.0::DOUBLE AS hx, 0.2::DOUBLE + (p_partkey % 7) / 10.0::DOUBLE AS hy, radians(p_partkey * 37 % 180) AS a FROM part),
    c AS (SELECT id, hx + hy AS r, cx, cy, unnest([1, 2, 3, 4]) AS k, unnest([1, -1, -1, 1]) AS u, unnest([1, 1, -1, -1]) AS v, hx, hy, a FROM b),
    v AS (SELECT id, r, cx, cy, k, cx + u * hx * cos(a) - v * hy * sin(a) AS x, cy + u * hx * sin(a) + v * hy * cos(a) AS y FROM c),
    e AS (SELECT p.*, q.x AS x2, q.y AS y2 FROM v p JOIN v q ON p.id = q.id AND q.k = p.k % 4 + 1),
    n AS (SELECT p.id, q.id AS other FROM b p JOIN b q ON p.id < q.id AND sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2) <= p.hx + p.hy + q.hx + q.hy + 0.25)"""
#: What each edge of the other rectangle leaves of a rectangle: corners to its left, and crossings.
_CUT = """, w{k} AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM s{k} WINDOW o AS (PARTITION BY id, other ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    d{k} AS (SELECT w.*, (e.x2 - e.x) * (w.y - e.y) - (e.y2 - e.y) * (w.x - e.x) AS sp, (e.x2 - e.x) * (ny - e.y) - (e.y2 - e.y) * (nx - e.x) AS sq FROM w{k} w JOIN e ON e.id = w.other AND e.k = {k}),
    s{next} AS (SELECT id, other, 2 * i AS i, x, y FROM d{k} WHERE sp >= 0 UNION ALL SELECT id, other, 2 * i + 1, x + sp / (sp - sq) * (nx - x), y + sp / (sp - sq) * (ny - y) FROM d{k} WHERE (sp >= 0) <> (sq >= 0))"""


@query("footprint_gaps", f"""WITH {_BOXES}, s1 AS (SELECT n.id, n.other, k AS i, x, y FROM n JOIN v ON v.id = n.id){''.join(_CUT.format(k=k, next=k + 1) for k in (1, 2, 3, 4))},
    f AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM s5 WINDOW o AS (PARTITION BY id, other ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    area AS (SELECT id, other, abs(sum(x * ny - nx * y)) / 2 AS overlap FROM f GROUP BY id, other),
    t AS (SELECT n.id, n.other, p.x, p.y, e.x AS ex, e.y AS ey, e.x2 - e.x AS dx, e.y2 - e.y AS dy FROM n JOIN v p ON p.id = n.id JOIN e ON e.id = n.other
      UNION ALL SELECT n.id, n.other, p.x, p.y, e.x, e.y, e.x2 - e.x, e.y2 - e.y FROM n JOIN v p ON p.id = n.other JOIN e ON e.id = n.id),
    g AS (SELECT id, other, min(sqrt((x - ex - l * dx) ** 2 + (y - ey - l * dy) ** 2)) AS gap FROM (SELECT *, greatest(0, least(1, ((x - ex) * dx + (y - ey) * dy) / (dx * dx + dy * dy))) AS l FROM t) GROUP BY id, other)
    SELECT id, other, round(CASE WHEN area.overlap IS NULL THEN gap ELSE 0 END, 6) AS gap, round(coalesce(area.overlap, 0), 6) AS overlap FROM g LEFT JOIN area USING (id, other) WHERE area.overlap IS NOT NULL OR gap <= 0.25""")
def footprint_gaps(spark, sf_dir):
    """How far rotated pieces within a quarter of a unit are apart, and what they have in common."""
    k = F.col("p_partkey")
    boxes = table(spark, sf_dir, "part").select(
        k.alias("id"), (F.floor(k / 40) * 2.5).alias("cx"), ((k % 40) * 1.5).alias("cy"), (0.3 + F.col("p_size") / 40.0).alias("half_x"), (0.2 + (k % 7) / 10.0).alias("half_y"), F.radians(k * 37 % 180).alias("angle")
    )
    near = footprints.near_footprints(boxes, "id", 0.25)
    return near.select("id", "other", F.round("gap", 6).alias("gap"), F.round("overlap", 6).alias("overlap"))


@query("segments_within", """WITH s AS (SELECT p_partkey AS id, (p_partkey // 40) * 2.5::DOUBLE AS x1, (p_partkey % 40) * 1.5::DOUBLE AS y1, (p_partkey // 40) * 2.5 + p_size / 10.0::DOUBLE * cos(radians(p_partkey * 37 % 360)) AS x2, (p_partkey % 40) * 1.5 + p_size / 10.0::DOUBLE * sin(radians(p_partkey * 37 % 360)) AS y2 FROM part),
    n AS (SELECT p.id AS probe, q.id AS segment, [p.x1, p.y1, p.x2, p.y2] AS p, [q.x1, q.y1, q.x2, q.y2] AS q FROM s p JOIN s q ON p.id % 3 = 0 AND q.id % 3 <> 0 AND least(p.x1, p.x2) <= greatest(q.x1, q.x2) + 0.2 AND least(q.x1, q.x2) <= greatest(p.x1, p.x2) + 0.2 AND least(p.y1, p.y2) <= greatest(q.y1, q.y2) + 0.2 AND least(q.y1, q.y2) <= greatest(p.y1, p.y2) + 0.2),
    t AS (SELECT probe, segment, p, q, unnest([p[1], p[3], q[1], q[3]]) AS x, unnest([p[2], p[4], q[2], q[4]]) AS y, unnest([q, q, p, p]) AS e FROM n),
    d AS (SELECT probe, segment, any_value(p) AS p, any_value(q) AS q, min(sqrt((x - e[1] - l * (e[3] - e[1])) ** 2 + (y - e[2] - l * (e[4] - e[2])) ** 2)) AS d
      FROM (SELECT *, coalesce(greatest(0, least(1, ((x - e[1]) * (e[3] - e[1]) + (y - e[2]) * (e[4] - e[2])) / nullif((e[3] - e[1]) ** 2 + (e[4] - e[2]) ** 2, 0))), 0) AS l FROM t) GROUP BY probe, segment),
    x AS (SELECT *, ((q[3] - q[1]) * (p[2] - q[2]) - (q[4] - q[2]) * (p[1] - q[1])) * ((q[3] - q[1]) * (p[4] - q[2]) - (q[4] - q[2]) * (p[3] - q[1])) < 0
      AND ((p[3] - p[1]) * (q[2] - p[2]) - (p[4] - p[2]) * (q[1] - p[1])) * ((p[3] - p[1]) * (q[4] - p[2]) - (p[4] - p[2]) * (q[3] - p[1])) < 0 AS crosses FROM d)
    SELECT probe, segment, round(CASE WHEN crosses THEN 0 ELSE d END, 6) AS distance FROM x WHERE crosses OR d <= 0.2""")
def segments_within(spark, sf_dir):
    """Walls within a fifth of a unit of a route's legs."""
    k, size = F.col("p_partkey"), F.col("p_size") / 10.0
    x, y, a = F.floor(k / 40) * 2.5, (k % 40) * 1.5, F.radians(k * 37 % 360)
    s = table(spark, sf_dir, "part").select(k.alias("id"), x.alias("x1"), y.alias("y1"), (x + size * F.cos(a)).alias("x2"), (y + size * F.sin(a)).alias("y2"))
    legs, walls = s.filter("id % 3 = 0").withColumnRenamed("id", "probe"), s.filter("id % 3 <> 0").withColumnRenamed("id", "segment")
    return footprints.near_segments(legs, walls, "probe", "segment", 0.2, 1.0).select("probe", "segment", F.round("distance", 6).alias("distance"))
