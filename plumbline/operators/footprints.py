"""Exact distances and overlaps of footprints and segments, as expressions over joins by cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.tables import dealt


def corners(cx: Column, cy: Column, hx: Column, hy: Column, angle: Column) -> Column:
    """The corners (x, y) of a rotated rectangle, counter-clockwise."""
    c, s = F.cos(angle), F.sin(angle)
    at = lambda u, v: F.struct((cx + u * hx * c - v * hy * s).alias("x"), (cy + u * hx * s + v * hy * c).alias("y"))
    return F.array(at(1, 1), at(-1, 1), at(-1, -1), at(1, -1))


def _edges(polygon: Column) -> Column:
    """(x, y) and (u, v): each corner with the next one."""
    turned = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, turned, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v")))


def _to_edge(p: Column, e: Column) -> Column:
    """Squared distance of a point (x, y) from a segment (x, y, u, v)."""
    dx, dy = e["u"] - e["x"], e["v"] - e["y"]
    along = F.coalesce(F.try_divide((p["x"] - e["x"]) * dx + (p["y"] - e["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.pow(p["x"] - e["x"] - t * dx, F.lit(2.0)) + F.pow(p["y"] - e["y"] - t * dy, F.lit(2.0))


def _side(e: Column, p: Column) -> Column:
    """Above zero to the left of the edge."""
    return (e["u"] - e["x"]) * (p["y"] - e["y"]) - (e["v"] - e["y"]) * (p["x"] - e["x"])


def clipped(a: Column, b: Column) -> Column:
    """The part of the convex polygon `a` inside the convex, counter-clockwise polygon `b`: its corners, or none.

    Each edge of `b` keeps what lies to its left: corners there, and where an edge of what is left crosses it.
    """

    def cut(polygon: Column, e: Column) -> Column:
        def step(f: Column) -> Column:
            p, q = F.struct(f["x"].alias("x"), f["y"].alias("y")), F.struct(f["u"].alias("x"), f["v"].alias("y"))
            sp, sq = _side(e, p), _side(e, q)
            t = F.try_divide(sp, sp - sq)
            crossing = F.struct((f["x"] + t * (f["u"] - f["x"])).alias("x"), (f["y"] + t * (f["v"] - f["y"])).alias("y"))
            kept = F.when(sp >= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0))
            return F.when((sp >= 0) != (sq >= 0), F.concat(kept, F.array(crossing))).otherwise(kept)

        return F.flatten(F.transform(_edges(polygon), step))

    return F.aggregate(_edges(b), a, cut)


def area(polygon: Column) -> Column:
    """The area of a simple polygon; of none, 0."""
    return F.abs(F.aggregate(_edges(polygon), F.lit(0.0), lambda s, e: s + (e["x"] * e["v"] - e["u"] * e["y"]) / 2))


def gap(a: Column, b: Column) -> Column:
    """The distance of two convex, counter-clockwise polygons: 0 where they meet, else between a corner and an edge.

    They are apart if some edge of either has all corners of the other strictly to its right.
    """
    beyond = lambda p, q: F.exists(_edges(p), lambda e: F.forall(q, lambda c: _side(e, c) < 0))
    nearest = lambda p, q: F.array_min(F.transform(p, lambda c: F.array_min(F.transform(_edges(q), lambda e: _to_edge(c, e)))))
    return F.when(beyond(a, b) | beyond(b, a), F.sqrt(F.least(nearest(a, b), nearest(b, a)))).otherwise(F.lit(0.0))


def near_footprints(boxes: DataFrame, key: str, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rotated rectangles (by, key, cx, cy, half_x, half_y, angle) at most `reach` apart: key, other (larger), gap, overlap.

    overlap: the area in common. Rectangles go to the cells that their bounds reach; a pair is judged in the first cell
    that both bounds share, by bounds first, then exactly. Null or non-finite measures are near nothing. Cells meet by
    shuffles, whatever the size of the table's file.
    """
    size = 2 * (F.col("half_x") + F.col("half_y"))
    sound = boxes.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in ("cx", "cy", "half_x", "half_y", "angle")))
    c, s = F.abs(F.cos("angle")), F.abs(F.sin("angle"))
    wide, high = F.col("half_x") * c + F.col("half_y") * s, F.col("half_x") * s + F.col("half_y") * c
    bounds = dealt(sound, key).select(
        *by, key, corners(*[F.col(x) for x in ("cx", "cy", "half_x", "half_y", "angle")]).alias("shape"), size.alias("size"),
        (F.col("cx") - wide).alias("x1"), (F.col("cx") + wide).alias("x2"), (F.col("cy") - high).alias("y1"), (F.col("cy") + high).alias("y2"),
    )
    # A cell as large as the mean rectangle and the reach: few cells a rectangle, few rectangles a cell.
    mean = bounds.agg(F.avg("size")).first()[0]
    cell = max(reach, (mean or 0.0) / 2, 1e-9)
    low, high_ = lambda v: F.floor((F.col(v) - reach / 2) / cell), lambda v: F.floor((F.col(v) + reach / 2) / cell)
    placed = bounds.withColumns({"i0": low("x1"), "j0": low("y1")}).withColumn("i", F.explode(F.sequence("i0", high_("x2")))).withColumn("j", F.explode(F.sequence("j0", high_("y2")))).drop("size")
    other = placed.select(*by, "i", "j", *[F.col(x).alias(f"o_{x}") for x in (key, "shape", "x1", "x2", "y1", "y2", "i0", "j0")])
    once = (F.col("i") == F.greatest("i0", "o_i0")) & (F.col("j") == F.greatest("j0", "o_j0"))
    close = (F.col("x1") <= F.col("o_x2") + reach) & (F.col("o_x1") <= F.col("x2") + reach) & (F.col("y1") <= F.col("o_y2") + reach) & (F.col("o_y1") <= F.col("y2") + reach)
    met = placed.join(other.hint("merge"), [*by, "i", "j"]).filter((F.col(key) < F.col(f"o_{key}")) & once & close)
    exact = met.withColumn("gap", gap(F.col("shape"), F.col("o_shape"))).filter(F.col("gap") <= reach)
    overlap = F.when(F.col("gap") == 0, area(clipped(F.col("shape"), F.col("o_shape")))).otherwise(F.lit(0.0))
    return exact.select(*by, key, F.col(f"o_{key}").alias("other"), "gap", overlap.alias("overlap"))


def segment_distance(a: Column, b: Column) -> Column:
    """The distance of two segments (x, y, u, v): 0 where they meet, else from an end of one to the other."""
    start, end = lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y")), lambda e: F.struct(e["u"].alias("x"), e["v"].alias("y"))
    apart = lambda e, f: _side(e, start(f)) * _side(e, end(f))
    # Ends on both sides of each other's line; segments that touch or lie on one line are found by their ends.
    cross = (apart(a, b) < 0) & (apart(b, a) < 0)
    ends = F.least(_to_edge(start(a), b), _to_edge(end(a), b), _to_edge(start(b), a), _to_edge(end(b), a))
    return F.when(cross, F.lit(0.0)).otherwise(F.sqrt(ends))


def _crossed(segments: DataFrame, cell: float, radius: float) -> DataFrame:
    """`segments` (x1, y1, x2, y2) once for each cell (i, j) within `radius` of what lies in a column of cells."""
    x, u, y, v = (F.col(c) for c in ("x1", "x2", "y1", "y2"))
    low, high = F.least(x, u), F.greatest(x, u)
    columns = segments.withColumn("i", F.explode(F.sequence(F.floor((low - radius) / cell), F.floor((high + radius) / cell))))
    # The heights between which the segment lies over the column, widened by the radius.
    at = lambda edge: y + (v - y) * F.coalesce(F.try_divide(F.greatest(low, F.least(high, edge)) - x, u - x), F.lit(0.0))
    left, right = at(F.col("i") * cell - radius), at((F.col("i") + 1) * cell + radius)
    steep = low == high
    bottom, top = F.when(steep, F.least(y, v)).otherwise(F.least(left, right)), F.when(steep, F.greatest(y, v)).otherwise(F.greatest(left, right))
    slack = radius + 1e-9 * cell
    return columns.withColumn("j", F.explode(F.sequence(F.floor((bottom - slack) / cell), F.floor((top + slack) / cell))))


def near_segments(probes: DataFrame, segments: DataFrame, probe: str, segment: str, radius: float, cell: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, probe, segment, distance): pairs of segments (by, id, x1, y1, x2, y2) at most `radius` apart.

    The index holds a segment in each cell that it crosses; a probe asks the cells within the radius of its own, and
    distances are exact. Cells far longer than segments make crowds, far shorter ones many rows a segment.
    """
    sound = lambda df: df.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in ("x1", "y1", "x2", "y2")))
    line = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("u"), F.col("y2").alias("v"))
    asks = _crossed(dealt(sound(probes), probe), cell, radius).select(*by, probe, F.col("i").alias("_i"), F.col("j").alias("_j"), line.alias("_p"))
    index = _crossed(dealt(sound(segments), segment), cell, 0.0).select(*by, segment, F.col("i").alias("_i"), F.col("j").alias("_j"), line.alias("_s"))
    met = asks.join(index.hint("merge"), [*by, "_i", "_j"]).select(*by, probe, segment, segment_distance(F.col("_p"), F.col("_s")).alias("distance"))
    # A pair may meet in several cells.
    return met.filter(F.col("distance") <= radius).groupBy(*by, probe, segment).agg(F.min("distance").alias("distance"))
