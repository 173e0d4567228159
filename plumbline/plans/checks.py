"""Checks measured from the pieces of scenes: each gives observations (scene, check, id, outcome, measured).

Pieces: scene, id, role, x, y (the centre), width, depth (along x and y), bottom, top; all in inches, boxes along the
axes. Roles: wall, toilet, bar, sink, mirror, counter, lowered (a counter's accessible portion), reader, table,
mounted, control, ramp (with run and rise), landing, rail, door. Scenes are bounded, and pieces meet by scene and role.

outcome: passes, problem, or question, where a measure is missing or the uncertainty straddles the limit. Rows of
null measures are questions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits in inches, from the public accessibility standard, by check: fixed values.
COUNTER, READER, TOILET, SIDE_BAR, REAR_BAR, BAR_HEIGHT = 36.0, 36.0, (16.0, 18.0), 42.0, 36.0, (33.0, 36.0)
RIM, MIRROR, DOOR, PROJECTION, EDGES, DINING, DINING_SHARE, REACH = 34.0, 40.0, 32.0, 4.0, (27.0, 80.0), (28.0, 34.0), 0.05, (15.0, 48.0)
RUN_PER_RISE, RAMP_RISE, RAMP_WIDTH, LANDING, RAILED_FROM, RAIL_HEIGHT = 12.0, 30.0, 36.0, 60.0, 6.0, (34.0, 38.0)
#: A limit is met within this.
AT_LIMIT = 1e-6


def judged(value: Column, low: float | None = None, high: float | None = None, uncertainty: float = 0.0) -> Column:
    """passes if the value is between the limits for certain, problem if it is beyond one for certain, else question."""
    inside, outside = F.lit(True), F.lit(False)
    if low is not None:
        inside, outside = inside & (value - uncertainty >= low - AT_LIMIT), outside | (value + uncertainty < low - AT_LIMIT)
    if high is not None:
        inside, outside = inside & (value + uncertainty <= high + AT_LIMIT), outside | (value - uncertainty > high + AT_LIMIT)
    return F.when(inside, "passes").when(outside, "problem").otherwise("question")


def _of(pieces: DataFrame, *roles: str) -> DataFrame:
    return pieces.filter(F.col("role").isin(*roles))


def _row(check: str, outcome: Column, measured: Column) -> list[Column]:
    return [F.col("scene"), F.lit(check).alias("check"), F.col("id"), outcome.alias("outcome"), measured.cast("double").alias("measured")]


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("scene", *[F.col(c).alias(f"{prefix}{c}") for c in ("id", "x", "y", "width", "depth", "bottom", "top")])


def counter_heights(pieces: DataFrame, uncertainty: float = 0.0) -> DataFrame:
    """Each scene's lowered portions, or its counters where it has none."""
    lowered, counters = _of(pieces, "lowered"), _of(pieces, "counter")
    rest = counters.join(lowered.select("scene").distinct(), "scene", "left_anti").select(counters.columns)
    return lowered.union(rest).select(*_row("service_counter_height", judged(F.col("top"), high=COUNTER, uncertainty=uncertainty), F.col("top")))


def reader_heights(pieces: DataFrame, uncertainty: float = 0.0, most_gap: float = 8.0) -> DataFrame:
    """Where a scene has a lowered portion, the top of what each reader stands on; nothing under it is a question."""
    readers = _of(pieces, "reader").join(_of(pieces, "lowered").select("scene").distinct(), "scene", "left_semi")
    under = _prefixed(_of(pieces, "counter", "lowered", "table"), "s_")
    holds = (F.abs(F.col("x") - F.col("s_x")) <= F.col("s_width") / 2) & (F.abs(F.col("y") - F.col("s_y")) <= F.col("s_depth") / 2) & (F.abs(F.col("bottom") - F.col("s_top")) <= most_gap)
    near = readers.join(under, "scene").filter(holds).groupBy("id").agg(F.min_by("s_top", F.struct(F.abs(F.col("bottom") - F.col("s_top")), -F.col("s_top"), "s_id")).alias("surface"))
    both = readers.join(near, "id", "left")
    return both.select(*_row("point_of_sale_height", judged(F.col("surface"), high=READER, uncertainty=uncertainty), F.col("surface")))


def toilet_places(pieces: DataFrame, reach: float = 36.0) -> DataFrame:
    """From a toilet's centre line to the face of the nearest wall beside it, parallel to it; none in reach is a question."""
    toilets = _of(pieces, "toilet")
    along = F.col("depth") >= F.col("width")
    walls = _prefixed(_of(pieces, "wall"), "w_").withColumn("w_along", F.col("w_depth") >= F.col("w_width"))
    away = F.when(along, F.abs(F.col("x") - F.col("w_x")) - F.col("w_width") / 2).otherwise(F.abs(F.col("y") - F.col("w_y")) - F.col("w_depth") / 2)
    beside = F.when(along, F.abs(F.col("y") - F.col("w_y")) <= F.col("w_depth") / 2).otherwise(F.abs(F.col("x") - F.col("w_x")) <= F.col("w_width") / 2)
    near = toilets.join(walls, "scene").filter((F.col("w_along") == along) & beside).withColumn("away", away).filter((F.col("away") >= 0) & (F.col("away") <= reach))
    found = toilets.join(near.groupBy("id").agg(F.min("away").alias("away")), "id", "left")
    return found.select(*_row("water_closet_location", judged(F.col("away"), *TOILET), F.col("away")))


def grab_bars(pieces: DataFrame, reach: float = 24.0) -> DataFrame:
    """The longest bar beside and behind each toilet, the shorter of the two by its limit deciding, and every bar's height.

    A toilet without one of them is a question. A bar is a toilet's if it lies within reach of its box.
    """
    toilets, bars = _of(pieces, "toilet"), _of(pieces, "bar")
    b = _prefixed(bars, "b_")
    gap = F.greatest(F.abs(F.col("x") - F.col("b_x")) - (F.col("width") + F.col("b_width")) / 2, F.abs(F.col("y") - F.col("b_y")) - (F.col("depth") + F.col("b_depth")) / 2)
    side = (F.col("b_depth") >= F.col("b_width")) == (F.col("depth") >= F.col("width"))
    length = F.greatest("b_width", "b_depth")
    near = toilets.join(b, "scene").filter(gap <= reach).groupBy("id").agg(F.max(F.when(side, length)).alias("beside"), F.max(F.when(~side, length)).alias("behind"))
    both = toilets.join(near, "id", "left")
    missing = F.col("beside").isNull() | F.col("behind").isNull()
    fits = (F.col("beside") >= SIDE_BAR - AT_LIMIT) & (F.col("behind") >= REAR_BAR - AT_LIMIT)
    short = F.when(~missing, F.least(F.col("beside") - SIDE_BAR, F.col("behind") - REAR_BAR))
    pairs = both.select(*_row("grab_bar_lengths", F.when(missing, "question").when(fits, "passes").otherwise("problem"), short))
    return pairs.union(bars.select(*_row("grab_bar_height", judged(F.col("top"), *BAR_HEIGHT), F.col("top"))))


def lavatories(pieces: DataFrame) -> DataFrame:
    """C17: the rims of sinks, and the lower edges of mirrors that hang over one: their extents on the floor's axes meet it, within a foot."""
    sinks = _of(pieces, "sink")
    over = _of(pieces, "mirror").join(_prefixed(sinks, "s_"), "scene")
    beside = (F.abs(F.col("x") - F.col("s_x")) <= (F.col("width") + F.col("s_width")) / 2) & (F.abs(F.col("y") - F.col("s_y")) <= (F.col("depth") + F.col("s_depth")) / 2 + 12) & (F.col("bottom") >= F.col("s_top") - AT_LIMIT)
    mirrors = over.filter(beside).select("scene", "id", "bottom").distinct()
    return sinks.select(*_row("lavatory_rim", judged(F.col("top"), high=RIM), F.col("top"))).union(mirrors.select(*_row("lavatory_mirror", judged(F.col("bottom"), high=MIRROR), F.col("bottom"))))


def doors(pieces: DataFrame) -> DataFrame:
    """A scan sees the frame, not the open leaf: wide or not, a door is a question, with its wider side."""
    wide = F.greatest("width", "depth")
    return _of(pieces, "door").select(*_row("door_clear_width", F.lit("question"), wide))


def protrusions(pieces: DataFrame, touching: float = 2.0) -> DataFrame:
    """C11: how far mounted pieces, whose lower edge is between the edges of the rule, stand out from the wall they hang on.

    The wall is the nearest one that the piece touches; its normal is its thinner axis, and the farthest corner along
    it less the wall's face is what stands out. A piece on no wall is a question.
    """
    hung = _of(pieces, "mounted").filter((F.col("bottom") > EDGES[0]) & (F.col("bottom") <= EDGES[1]))
    walls = _prefixed(_of(pieces, "wall"), "w_").withColumn("w_thin_x", F.col("w_width") <= F.col("w_depth"))
    across = lambda a, b: F.when(F.col("w_thin_x"), a).otherwise(b)
    off = across(F.abs(F.col("x") - F.col("w_x")), F.abs(F.col("y") - F.col("w_y")))
    own, face = across(F.col("width"), F.col("depth")) / 2, across(F.col("w_width"), F.col("w_depth")) / 2
    beside = across(F.abs(F.col("y") - F.col("w_y")) <= F.col("w_depth") / 2, F.abs(F.col("x") - F.col("w_x")) <= F.col("w_width") / 2)
    near = hung.join(walls, "scene").filter(beside & (off - own - face <= touching)).groupBy("id").agg(F.min_by(off + own - face, F.struct(off - face, "w_id")).alias("out"))
    return hung.join(near, "id", "left").select(*_row("protruding_objects", judged(F.col("out"), high=PROJECTION), F.col("out")))


def dining(pieces: DataFrame, uncertainty: float = 0.5) -> DataFrame:
    """Of a scene's tables, as many as the share asks for, one at least, must lie in the band; the row's id is the first table's.

    passes if so many lie there for certain, question if they may, problem otherwise. measured: those that do for certain.
    """
    how = judged(F.col("top"), *DINING, uncertainty=uncertainty)
    by = _of(pieces, "table").withColumn("how", how).groupBy("scene").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.count_if(F.col("how") == "passes").alias("sure"), F.count_if(F.col("how") != "problem").alias("may"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * DINING_SHARE - 1e-9))
    return by.select(*_row("dining_surface_height", F.when(F.col("sure") >= needed, "passes").when(F.col("may") >= needed, "question").otherwise("problem"), F.col("sure")))


def reaches(pieces: DataFrame) -> DataFrame:
    """A control's box that lies in the range passes, one outside it is a problem; one that reaches across a limit doesn't settle where its controls are."""
    low, high = REACH
    inside = (F.col("bottom") >= low - AT_LIMIT) & (F.col("top") <= high + AT_LIMIT)
    outside = (F.col("top") < low - AT_LIMIT) | (F.col("bottom") > high + AT_LIMIT)
    return _of(pieces, "control").select(*_row("reach_range", F.when(inside, "passes").when(outside, "problem").otherwise("question"), F.col("top")))


def ramps(pieces: DataFrame, reach: float = 6.0) -> DataFrame:
    """Of each ramp: run per rise (a flat one passes), rise, width, the shorter of its two landings, rails, and the worst rail's height.

    Landings and rails are those of its scene within reach of its box. A missing landing is a question; above
    `RAILED_FROM` of rise two rails are needed; the worst height is the one farthest from the band.
    """
    own = _of(pieces, "ramp")
    parts = _prefixed(_of(pieces, "landing", "rail").withColumn("id", F.struct("id", "role")), "p_")
    gap = F.greatest(F.abs(F.col("x") - F.col("p_x")) - (F.col("width") + F.col("p_width")) / 2, F.abs(F.col("y") - F.col("p_y")) - (F.col("depth") + F.col("p_depth")) / 2)
    rail, landing = F.col("p_id.role") == "rail", F.col("p_id.role") == "landing"
    off = F.greatest(F.lit(RAIL_HEIGHT[0]) - F.col("p_top"), F.col("p_top") - RAIL_HEIGHT[1])
    near = own.join(parts, "scene").filter(gap <= reach).groupBy("id").agg(
        F.count_if(landing).alias("landings"), F.min(F.when(landing, F.col("p_depth"))).alias("shortest"), F.count_if(rail).alias("rails"), F.max_by("p_top", F.when(rail, F.struct(off, -F.col("p_id.id")))).alias("worst")
    )
    r = own.join(near, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("landings", "rails")})
    slope = F.try_divide(F.col("run"), F.col("rise"))
    railed = F.when(F.col("rise") <= RAILED_FROM, "passes").when(F.col("rails") >= 2, "passes").when(F.col("rise").isNull(), "question").otherwise("problem")
    told = [
        ("ramp_slope", F.when(F.col("rise") == 0, "passes").otherwise(judged(slope, low=RUN_PER_RISE)), slope), ("ramp_rise", judged(F.col("rise"), high=RAMP_RISE), F.col("rise")),
        ("ramp_width", judged(F.col("width"), low=RAMP_WIDTH), F.col("width")), ("ramp_landings", F.when(F.col("landings") < 2, "question").otherwise(judged(F.col("shortest"), low=LANDING)), F.col("shortest")),
        ("ramp_handrails", railed, F.col("rails")),
    ]
    rows = r.select("scene", "id", "worst", F.inline(F.array(*[F.struct(F.lit(c).alias("check"), o.alias("outcome"), m.cast("double").alias("measured")) for c, o, m in told])))
    heights = r.filter("worst is not null").select(*_row("ramp_rail_height", judged(F.col("worst"), *RAIL_HEIGHT), F.col("worst")))
    return rows.select("scene", "check", "id", "outcome", "measured").union(heights)


def all_checks(pieces: DataFrame) -> DataFrame:
    """Observations of all checks of this module."""
    found = counter_heights(pieces)
    for check in (reader_heights, toilet_places, grab_bars, lavatories, doors, protrusions, dining, reaches, ramps):
        found = found.union(check(pieces))
    return found


def compliance(rules: DataFrame, scenes: DataFrame, observations: DataFrame) -> DataFrame:
    """(scene, rule, enabled, outcome, n) for every rule (rule, enabled) and every scene, and for observations of rules that nobody listed.

    outcome: of the rule's observations in the scene the worst, problem before question before passes; off where the rule
    isn't enabled; not evaluated where it has no observation. n: its observations there.
    """
    rank = F.when(F.col("outcome") == "problem", 2).when(F.col("outcome") == "question", 1).otherwise(0)
    seen = observations.groupBy("scene", F.col("check").alias("rule")).agg(F.max(rank).alias("worst"), F.count("*").alias("n"))
    # A row for each scene and rule is the result.
    asked = scenes.select("scene").distinct().crossJoin(rules.select("rule", "enabled"))
    both = asked.join(seen, ["scene", "rule"], "full")
    worst = F.element_at(F.array(F.lit("passes"), F.lit("question"), F.lit("problem")), F.col("worst") + 1)
    outcome = F.when(F.col("enabled").isNull(), "not listed").when(~F.col("enabled"), "off").when(F.col("worst").isNull(), "not evaluated").otherwise(worst)
    return both.select("scene", "rule", F.coalesce("enabled", F.lit(False)).alias("enabled"), outcome.alias("outcome"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def down(up: Sequence[Column]) -> Column:
    """The unit vector of gravity in a room's frame, from the frame's axis that points up; null for no axis."""
    size = F.sqrt(sum((c * c for c in up), F.lit(0.0)))
    return F.when(size > 0, F.array(*[-c / size for c in up]))


#: Piece-widths that set rows apart, inches from a wall that are its edge, and the share of a room that is a cluster: fixed values.
ROW_WIDTHS, WALL_EDGE, CLUSTER = 1.5, 24.0, 0.35


def arrangements(subjects: DataFrame, walls: DataFrame) -> DataFrame:
    """Q05: (scene, subject, n, rows, columns, row_spacing, column_spacing, shape) of sets of pieces (scene, subject, id, x, y, width, depth).

    Rows are chains along y, columns along x: a new one begins where the gap to the one before exceeds a piece-width and
    a half of the widest piece. Spacings are mean gaps of their centres, null for one. shape, the first that fits: one,
    pair, row; two_rows or grid where rows times columns are all pieces; ring where all but one at the most lie at a
    wall; cluster where they take up little of the room both ways; spread. Walls: scene, x, y, width, depth.
    """
    from pyspark.sql import Window

    by = ["scene", "subject"]
    tolerance = F.max(F.greatest("width", "depth")).over(Window.partitionBy(*by)) * ROW_WIDTHS
    rows = subjects.withColumn("_tolerance", tolerance)

    def chains(along: str, name: str, spacing: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(along, "id")
        new = F.when(F.col(along) - F.lag(along).over(w) > F.col("_tolerance"), 1).otherwise(0)
        chained = rows.select(*by, "id", along, "_tolerance").withColumn("_new", new).withColumn("_chain", F.sum("_new").over(w))
        centres = chained.groupBy(*by, "_chain").agg(F.avg(along).alias("c"), F.min(along).alias("low"), F.max(along).alias("high"))
        return centres.groupBy(*by).agg(F.count("*").alias(name), F.try_divide(F.max("c") - F.min("c"), F.count("*") - 1).alias(spacing), (F.max("high") - F.min("low")).alias(f"_{name}"))

    sides = walls.select("scene", *[F.col(c).alias(f"w_{c}") for c in ("x", "y", "width", "depth")])
    dx = F.greatest(F.lit(0.0), F.abs(F.col("x") - F.col("w_x")) - (F.col("width") + F.col("w_width")) / 2)
    dy = F.greatest(F.lit(0.0), F.abs(F.col("y") - F.col("w_y")) - (F.col("depth") + F.col("w_depth")) / 2)
    near = rows.join(sides, "scene").groupBy(*by, "id").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("gap"))
    hugging = near.groupBy(*by).agg(F.count_if(F.col("gap") <= WALL_EDGE).alias("_hugging"))
    room = walls.groupBy("scene").agg((F.max("x") - F.min("x")).alias("_wide"), (F.max("y") - F.min("y")).alias("_long"))
    all_of = rows.groupBy(*by).agg(F.count("*").alias("n"))
    whole = all_of.join(chains("y", "rows", "row_spacing"), by).join(chains("x", "columns", "column_spacing"), by).join(hugging, by, "left").join(room, "scene", "left")
    share = F.greatest(F.coalesce(F.try_divide(F.col("_rows"), F.col("_long")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("_columns"), F.col("_wide")), F.lit(0.0)))
    n, r, c = F.col("n"), F.col("rows"), F.col("columns")
    shape = (
        F.when(n == 1, "one").when(n == 2, "pair").when((r == 1) | (c == 1), "row").when((r * c == n) & (F.least(r, c) == 2) & (n == 4), "two_rows").when(r * c == n, "grid")
        .when(F.coalesce("_hugging", F.lit(0)) >= n - 1, "ring").when(share <= CLUSTER, "cluster").otherwise("spread")
    )
    return whole.select(*by, "n", "rows", "columns", "row_spacing", "column_spacing", shape.alias("shape"))
