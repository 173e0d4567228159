"""Clear spaces beside pieces, and what a changed layout may not do, from boxes of scenes.

Pieces: scene, id, x, y (the centre), width, depth along the axes. Scenes are bounded, and pieces meet by scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inches beside a door's latch, in front to pull and to push it, and the sides of a clear floor: fixed values.
LATCH, PULL, PUSH, CLEAR = 18.0, 60.0, 48.0, (30.0, 48.0)
#: Overlaps below this are none.
TOUCH = 1e-9


def _others(obstacles: DataFrame) -> DataFrame:
    return obstacles.select("scene", *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "width", "depth")])


def _overlap(x: Column, y: Column, w: Column, d: Column, prefix: str = "o_") -> Column:
    o = lambda c: F.col(f"{prefix}{c}")
    return (F.abs(x - o("x")) < (w + o("width")) / 2 - TOUCH) & (F.abs(y - o("y")) < (d + o("depth")) / 2 - TOUCH)


def door_clearances(doors: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(scene, id, outcome, depth) of doors in walls along x that open to larger y.

    The free depth before an opening wider by the latch side: up to the nearest obstacle in its width. Enough to pull
    passes either way, enough to push alone depends on how the door swings, less is a problem. No obstacle: no depth,
    and it passes.
    """
    wide = F.col("width") + LATCH
    ahead = F.col("o_y") - F.col("o_depth") / 2 - F.col("y") - F.col("depth") / 2
    beyond = F.col("o_y") + F.col("o_depth") / 2 > F.col("y") + F.col("depth") / 2 + TOUCH
    near = doors.join(_others(obstacles), "scene").filter((F.abs(F.col("x") - F.col("o_x")) < (wide + F.col("o_width")) / 2 - TOUCH) & beyond)
    free = near.groupBy("scene", "id").agg(F.min(F.greatest(F.lit(0.0), ahead)).alias("free"))
    depth = F.col("free")
    outcome = F.when(depth.isNull() | (depth >= PULL - 1e-6), "passes").when(depth >= PUSH - 1e-6, "question").otherwise("problem")
    return doors.select("scene", "id").join(free, ["scene", "id"], "left").select("scene", "id", outcome.alias("outcome"), depth.alias("depth"))


def clear_floors(kiosks: DataFrame, obstacles: DataFrame, room: tuple[float, float]) -> DataFrame:
    """(scene, id, outcome, face) of kiosks: whether a clear floor fits at a face, either way round, in the room.

    Faces are front (smaller y), right, back and left, 0 to 3; the first at which it fits is named, or the front.
    """
    short, long = CLEAR
    ways = []
    for face, (dx, dy) in enumerate(((0, -1), (1, 0), (0, 1), (-1, 0))):
        for w, d in ((short, long), (long, short)):
            x = F.col("x") + dx * (F.col("width") + w) / 2
            y = F.col("y") + dy * (F.col("depth") + d) / 2
            ways.append(F.struct(F.lit(face).alias("face"), x.alias("px"), y.alias("py"), F.lit(w).alias("pw"), F.lit(d).alias("pd")))
    places = kiosks.select("scene", "id", F.inline(F.array(*ways)))
    px, py, pw, pd = (F.col(c) for c in ("px", "py", "pw", "pd"))
    inside = (px - pw / 2 >= -TOUCH) & (py - pd / 2 >= -TOUCH) & (px + pw / 2 <= room[0] + TOUCH) & (py + pd / 2 <= room[1] + TOUCH)
    free = places.filter(inside).alias("p").join(_others(obstacles).alias("o"), (F.col("p.scene") == F.col("o.scene")) & (F.col("id") != F.col("o_id")) & _overlap(px, py, pw, pd), "left_anti")
    found = free.groupBy("scene", "id").agg(F.min("face").alias("fits"))
    return kiosks.select("scene", "id").join(found, ["scene", "id"], "left").select("scene", "id", F.when(F.col("fits").isNull(), "problem").otherwise("passes").alias("outcome"), F.coalesce("fits", F.lit(0)).alias("face"))


def layout_violations(before: DataFrame, after: DataFrame, zones: DataFrame, seen: DataFrame, room: tuple[float, float], most_move: float, cell: float, use: float) -> DataFrame:
    """(scene, id, violation) of pieces (with movable) that a new layout treats as it may not; each named once.

    locked_move, resized, removed, off_floor, too_far, and of moved or added pieces: collision with another piece,
    keep_clear (it lies in a zone (scene, zone, box) that it was clear of), unseen_floor (it covers the middle of a cell
    (scene, i, j) that isn't in `seen`), and lost_room: the strip of `use` before a piece, free before, is taken.
    """
    box = ("x", "y", "width", "depth")
    new = after.select("scene", "id", *[F.col(c).alias(f"n_{c}") for c in box], F.lit(True).alias("_after"))
    both = before.withColumn("_before", F.lit(True)).join(new, ["scene", "id"], "full")
    nx, ny, nw, nd = (F.col(f"n_{c}") for c in box)
    move = F.sqrt((nx - F.col("x")) ** 2 + (ny - F.col("y")) ** 2)
    moved = F.col("_after").isNotNull() & (F.col("_before").isNull() | (move > 1e-6))
    outside = (nx - nw / 2 < -TOUCH) | (ny - nd / 2 < -TOUCH) | (nx + nw / 2 > room[0] + TOUCH) | (ny + nd / 2 > room[1] + TOUCH)
    tests = {
        "removed": F.col("_after").isNull(), "locked_move": ~F.col("movable") & (move > 1e-6),
        "resized": (F.abs(nw - F.col("width")) > 1e-6) | (F.abs(nd - F.col("depth")) > 1e-6), "off_floor": moved & outside, "too_far": move > most_move,
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    plain = both.select("scene", "id", F.explode(named).alias("violation"))
    some = both.filter(moved)
    one = lambda df, kind: df.select("scene", "id").distinct().withColumn("violation", F.lit(kind))
    hits = some.join(_others(after), "scene").filter((F.col("id") != F.col("o_id")) & _overlap(nx, ny, nw, nd))
    z = zones.select("scene", *[F.col(c).alias(f"z_{c}") for c in box])
    was = F.coalesce(_overlap(*[F.col(c) for c in box], prefix="z_"), F.lit(False))
    blocked = some.join(z, "scene").filter(_overlap(nx, ny, nw, nd, prefix="z_") & ~was)
    # Middles of cells that lie under the piece.
    reach = lambda centre, size: F.sequence(F.ceil((centre - size / 2 + TOUCH) / cell - 0.5), F.floor((centre + size / 2 - TOUCH) / cell - 0.5))
    holds = (F.ceil((nx - nw / 2 + TOUCH) / cell - 0.5) <= F.floor((nx + nw / 2 - TOUCH) / cell - 0.5)) & (F.ceil((ny - nd / 2 + TOUCH) / cell - 0.5) <= F.floor((ny + nd / 2 - TOUCH) / cell - 0.5))
    covered = some.filter(holds).withColumn("i", F.explode(reach(nx, nw))).withColumn("j", F.explode(reach(ny, nd)))
    unseen = covered.join(seen.select("scene", "i", "j"), ["scene", "i", "j"], "left_anti")

    def strips(df: DataFrame) -> DataFrame:
        """Pieces whose strip in front is taken by another."""
        front = df.select("scene", "id", F.col("x").alias("px"), (F.col("y") - F.col("depth") / 2 - use / 2).alias("py"), F.col("width").alias("pw"))
        return front.join(_others(df), "scene").filter((F.col("id") != F.col("o_id")) & _overlap(F.col("px"), F.col("py"), F.col("pw"), F.lit(use))).select("scene", "id").distinct()

    stays = before.select("scene", "id").join(after.select("scene", "id"), ["scene", "id"], "left_semi")
    lost = strips(after).join(stays, ["scene", "id"], "left_semi").join(strips(before), ["scene", "id"], "left_anti")
    return plain.union(one(hits, "collision")).union(one(blocked, "keep_clear")).union(one(unseen, "unseen_floor")).union(one(lost, "lost_room"))
