"""Scenes: measured pieces in trees of what carries what, and what is worked out from their boxes.

A piece is a row (scene, id, parent, relation, label, attached, touches, matrix, w, d, h): its box has the extents w, d
and h in its own frame, and `matrix`, row-major, puts it into the scene's frame with z up. A scene has a bounded number
of pieces; joins are by scene and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators.containment import held_in

#: Rotation between a frame with y up and one with z up, and back, as rows: fixed values.
TO_Z_UP = ((1.0, 0.0, 0.0, 0.0), (0.0, 0.0, -1.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))
TO_Y_UP = ((1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, -1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0))
#: Markings are measured from this least confidence on.
SURE = 0.6


def up_extent(matrix: Column, sizes: list[Column]) -> Column:
    """How high a box stands in its scene."""
    return sum((F.abs(matrix[8 + i]) * sizes[i] for i in range(3)), F.lit(0.0))


def oriented(matrix: Column, sizes: list[Column]) -> Column:
    """(width, depth, height): the axis that points up most gives the height's place; the others, the larger first."""
    turn = [F.abs(matrix[8 + i]) for i in range(3)]
    up = F.when((turn[0] >= turn[1]) & (turn[0] >= turn[2]), 0).when(turn[1] >= turn[2], 1).otherwise(2)
    pairs = {0: (1, 2), 1: (0, 2), 2: (0, 1)}
    pick = lambda f: F.when(up == 0, f(*[sizes[i] for i in pairs[0]])).when(up == 1, f(*[sizes[i] for i in pairs[1]])).otherwise(f(*[sizes[i] for i in pairs[2]]))
    return F.struct(pick(F.greatest).alias("width"), pick(F.least).alias("depth"), up_extent(matrix, sizes).alias("height"))


def predicates(pieces: DataFrame) -> DataFrame:
    """`pieces` with width, depth, height, shell, flat, upright, mounted, hosts, on_floor and obstacle.

    on_floor: nothing carries the piece, or a flat sheet does and the piece rests on it. An obstacle stands upright as
    a sheet, or touches the floor that it stands on, and isn't mounted on anything. A parent that isn't in the scene
    carries nothing to the floor.
    """
    sizes = [F.col(c) for c in ("w", "d", "h")]
    shell = X.sheet(*sizes)
    seen = pieces.withColumns({"m": oriented(F.col("matrix"), sizes), "shell": shell}).select("*", "m.width", "m.depth", "m.height").drop("m")
    seen = seen.withColumns(
        {
            "flat": F.col("shell") & (F.col("height") <= X.SHEET_THICKNESS),
            "upright": F.col("shell") & (F.col("height") > X.SHEET_THICKNESS),
            "mounted": F.col("attached"),
            "hosts": F.col("shell") | (F.col("width") * F.col("depth") >= X.SHEET_AREA),
        }
    )
    under = seen.select("scene", F.col("id").alias("parent"), F.col("flat").alias("on_flat"))
    both = seen.join(under, ["scene", "parent"], "left")
    on_floor = F.col("parent").isNull() | (F.coalesce("on_flat", F.lit(False)) & F.coalesce(F.col("relation") == "rests_on", F.lit(False)))
    both = both.withColumn("on_floor", on_floor).drop("on_flat")
    return both.withColumn("obstacle", (F.col("upright") | (F.col("touches") & F.col("on_floor"))) & ~F.col("mounted"))


def multiplied(a: list[list], b: list[list]) -> list[list]:
    """Product of two 4 x 4 matrices whose cells are columns or numbers; what is zero by its form isn't written."""

    def cell(r: int, c: int) -> Column:
        parts = [(x, y) for x, y in ((a[r][k], b[k][c]) for k in range(4)) if not (isinstance(x, float) and x == 0) and not (isinstance(y, float) and y == 0)]
        return sum((F.lit(x) * y if isinstance(x, float) else x * F.lit(y) if isinstance(y, float) else x * y for x, y in parts), F.lit(0.0))

    return [[cell(r, c) for c in range(4)] for r in range(4)]


def pose_to_z_up(columns: Column) -> Column:
    """The row-major pose with z up of a column-major one with y up."""
    rows = [[columns[4 * c + r] for c in range(4)] for r in range(4)]
    turned = multiplied(multiplied([list(x) for x in TO_Z_UP], rows), [list(x) for x in TO_Y_UP])
    return F.array(*[x for row in turned for x in row])


def into_room(x: Column, y: Column, z: Column, floor: Column) -> Column:
    """A point of a capture with y up in the room's frame, whose floor, at height `floor` there, is at 0."""
    return F.struct(x.alias("x"), (F.lit(0.0) - z).alias("y"), (y - floor).alias("z"))


def joined_meshes(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`parts` (vertices, flat by threes, and triangles) with offset, and triangles numbered over all parts of a key.

    What is summed in order is a number a part; arrays stay in their rows.
    """
    from pyspark.sql import Window as W

    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = (F.size("vertices") / 3).cast("long")
    placed = parts.withColumn("offset", F.coalesce(F.sum(own).over(before), F.lit(0).cast("long")))
    return placed.withColumn("triangles", F.transform("triangles", lambda t: t + F.col("offset")))


def strongest_moves(answers: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One move a piece (keys): that of the answer with the highest reward, and of those the first in `order`."""
    best = F.max_by(F.struct(*answers.columns), F.struct("reward", *[-c for c in order]))
    return answers.groupBy(*keys).agg(best.alias("m")).select("m.*")


def once_only(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in `order`, which must tell rows apart."""
    rest = [c for c in items.columns if c not in (key, *order)]
    first = items.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select(key, "f.*")


def texts_on(pieces: DataFrame, markings: DataFrame) -> DataFrame:
    """id, texts (in order of place) and quality: measured, low (any marking under SURE), or none."""
    by = markings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("m"), F.min("confidence").alias("least"))
    quality = F.when(F.col("least") >= SURE, "measured").when(F.col("least").isNotNull(), "low").otherwise("none")
    return pieces.select("id").join(by, "id", "left").select("id", F.array_join(F.transform("m", lambda x: x["text"]), " | ").alias("texts"), quality.alias("quality"))


def counted(pieces: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, label, n and found for each word of `asked` (few): labels that hold it, or all labels where none does."""
    tally = pieces.groupBy("label").agg(F.count("*").alias("n"))
    words = asked.select("asked").distinct().withColumn("_asked", F.lower("asked"))
    held = held_in(words, tally.select(F.lower("label").alias("_label")), "_asked", "_label")
    fits = words.join(held, "_asked").join(tally.withColumn("_label", F.lower("label")), "_label").select("asked", "label", "n", F.lit(True).alias("found"))
    # A word that no label holds gets all labels: as many rows as there are, by definition.
    rest = words.join(held, "_asked", "left_anti").filter("_asked <> ''").select("asked").crossJoin(tally).select("asked", "label", "n", F.lit(False).alias("found"))
    every = words.filter("_asked = ''").select("asked").crossJoin(tally).select("asked", "label", "n", F.lit(True).alias("found"))
    return fits.union(rest).union(every)


def measured(pieces: DataFrame) -> DataFrame:
    """(scene, id, floor_area, clearance): square inches of floor, and inches from the top to the highest wall's.

    pieces: predicates' columns with z, the height of the centre. Floor area isn't measurable for a carried piece;
    clearance isn't in a scene without walls, and never below 0.
    """
    walls = pieces.filter("upright").groupBy("scene").agg(F.max(F.col("z") + F.col("height") / 2).alias("wall_top"))
    area = F.when(F.col("on_floor"), F.col("width") * F.col("depth") / X.INCH**2)
    above = F.greatest(F.lit(0.0), F.col("wall_top") - F.col("z") - F.col("height") / 2) / X.INCH
    return pieces.join(walls, "scene", "left").select("scene", "id", area.alias("floor_area"), above.alias("clearance"))


def moved(pieces: DataFrame, moves: DataFrame) -> DataFrame:
    """(scene, id, x, y, carried_by) after moves (id, dx, dy), one a piece: riders go along with what carries them.

    A piece with a move of its own goes by that alone; others by the nearest mover among their carriers.
    """
    from plumbline.operators import rel

    edges = pieces.filter("parent is not null").select("parent", F.col("id").alias("child"))
    up = rel.ancestors(edges).select(F.col("node").alias("id"), "ancestor", "depth").union(pieces.select("id", F.col("id"), F.lit(0)))
    nearest = up.join(moves.withColumnRenamed("id", "ancestor"), "ancestor").groupBy("id").agg(F.min_by(F.struct("ancestor", "dx", "dy"), "depth").alias("m"))
    zero = F.lit(0.0)
    return pieces.join(nearest, "id", "left").select(
        "scene", "id", (F.col("x") + F.coalesce("m.dx", zero)).alias("x"), (F.col("y") + F.coalesce("m.dy", zero)).alias("y"), F.when(F.col("m.ancestor") != F.col("id"), F.col("m.ancestor")).alias("carried_by")
    )
