"""Column builders: units, poses, predicates, three-valued comparisons, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres to an inch: exact.
INCH = 0.0254
#: Tolerances, thresholds and limits of the measured-space model: fixed values.
SHEET_THICKNESS, SHEET_AREA, SHEET_LENGTH = 0.05, 1.0, 2.0
STEP_OVER, HEADROOM = 0.25 * INCH, 27 * INCH
EQUAL_METRES, AT_LIMIT = 0.01, 1e-6
UNITS = {"m": 1.0, "mm": 0.001, "cm": 0.01, "in": 0.0254}


def inches(metres: Column) -> Column:
    return metres / INCH


def metres(inches_: Column) -> Column:
    return inches_ * INCH


def position(matrix: Column) -> Column:
    """The translation of a row-major 4 x 4 matrix."""
    return F.struct(matrix[3].alias("x"), matrix[7].alias("y"), matrix[11].alias("z"))


def sheet(x: Column, y: Column, z: Column) -> Column:
    """Whether a box is a room's shell: thin, and wide or long."""
    d = F.array_sort(F.array(x, y, z))
    return (d[0] <= SHEET_THICKNESS) & (d[1] > SHEET_THICKNESS) & ((d[1] * d[2] >= SHEET_AREA) | (d[2] >= SHEET_LENGTH))


def blocks_floor(passable: Column, extent: Column, candidate: Column, bottom: Column, top: Column) -> Column:
    return ~passable & (extent > 0) & ~candidate & (top > STEP_OVER) & (bottom < HEADROOM)


def compared(value: Column, how: str, other: Column) -> Column:
    """A plan's comparison; equality has a tolerance of a centimetre. Anything else is an error."""
    ops = {
        "lt": value < other,
        "gt": value > other,
        "lte": value <= other,
        "gte": value >= other,
        "eq": F.abs(value - other) <= EQUAL_METRES,
        "ne": F.abs(value - other) > EQUAL_METRES,
    }
    if how not in ops:
        raise ValueError(f"unknown comparison {how!r}")
    return ops[how]


def meets(value: Column, comparison: str, threshold: Column) -> Column:
    """at_least or at_most, with a tolerance of a millionth."""
    if comparison == "at_least":
        return value >= threshold - AT_LIMIT
    if comparison == "at_most":
        return value <= threshold + AT_LIMIT
    raise ValueError(f"unknown comparison {comparison!r}")


def interval_verdict(low: Column, high: Column, limit: Column, head: str, inclusive: bool = True, eps: float = 0.0) -> Column:
    """satisfied, violation or needs_verification of a value known only between bounds.

    head: min (the value must be at least the limit) or max (at most). A null bound is unknown, and concludes nothing.
    """
    if head == "min":
        good, bad = (low >= limit - eps, high < limit - eps) if inclusive else (low > limit + eps, high <= limit + eps)
    elif head == "max":
        good, bad = (high <= limit + eps, low > limit + eps) if inclusive else (high < limit - eps, low >= limit - eps)
    else:
        raise ValueError(f"unknown head {head!r}")
    no = F.lit(False)
    return F.when(F.coalesce(good, no), "satisfied").when(F.coalesce(bad, no), "violation").otherwise("needs_verification")


def in_metres(value: Column, unit: Column) -> Column:
    """Metres; null for an unknown unit or a value that isn't finite."""
    factor = F.create_map(*[x for u, f in UNITS.items() for x in (F.lit(u), F.lit(f))])
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, value * F.try_element_at(factor, unit))


def name_has_words(name: Column, query: str) -> Column:
    """Whether every word of the query is part of the name, whatever the case."""
    words = query.lower().split()
    return F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(name), w)) if words else F.lit(True)


def normalised(name: Column) -> Column:
    """Distinct words of a name: lower case, hyphens and underscores as spaces."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.translate(name, "-_", "  ")), r"\s+"), lambda w: w != "")))


def three_way(a: Column, b: Column, tolerance: float = EQUAL_METRES) -> Column:
    """-1, 0 or 1, with a tie inside the tolerance."""
    return F.when(F.abs(a - b) <= tolerance, 0).when(a < b, -1).otherwise(1)


def gap_1d(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Distance between two intervals, 0 where they touch."""
    return F.greatest(a_low - b_high, b_low - a_high, F.lit(0.0))


def interval_sum(low: str, high: str) -> tuple[Column, Column]:
    """Aggregates: sums of bounds, each null unless all its parts are known."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    return whole(low).alias(low), whole(high).alias(high)


def required_count(n: Column, share: Column) -> Column:
    """How many of n a share asks for: at least one, and none of none."""
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n * share))).cast("int")
