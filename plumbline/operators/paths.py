"""Operators along a walk whose next choice needs the one before, without a task for each walk.

What follows a row, were it kept, is a pointer to a later row; pointers of all rows are found at once, and the rows
that are kept are those that the first one reaches, by doubling pointers. Arc lengths are running totals, and chunks
of a walk overlap by as far as an operator looks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.seq import running_totals
from plumbline.tables import cut


def numbered(rows: DataFrame, by: Sequence[str], order: str, cell: Column, name: str = "n") -> DataFrame:
    """`rows` with their place, from 1, in `order` within their walk; only the rows of a cell are ordered together.

    Orders are distinct in a walk, and cells follow them.
    """
    return running_totals(rows.withColumns({"_cell": cell, "_one": F.lit(1).cast("long")}), by, "_cell", order, {"_one": name}).drop("_cell", "_one")


def followed_by(rows: DataFrame, by: Sequence[str], n: str, at: Sequence[str], far: Callable[[Callable[[str], Column]], Column], could: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], first: int = 16) -> DataFrame:
    """(by, n, next): the first later row of the walk that is `far` from row n; rows that none follows are left out.

    The rows looked at lie in a window that begins at `first` rows and doubles for those that have found none. Rows of
    the window meet in blocks, and only in blocks whose bounds `could` hold a row that is far.
    far(o): the condition, with o(c) the later row's column. could(low, high): it on the bounds of a block's columns.
    """
    last = rows.groupBy(*by).agg(F.max(n).alias("_last"))
    left, low, width, found = cut(rows.join(last, list(by)).filter(F.col(n) < F.col("_last"))), 0, first, None
    later = rows.select(*by, *[F.col(c).alias(f"_o_{c}") for c in [n, *at]])
    while not left.isEmpty():
        block = later.withColumn("_block", F.floor(F.col(f"_o_{n}") / width))
        bounds = block.groupBy(*by, "_block").agg(*[f(f"_o_{c}").alias(f"_{s}_{c}") for c in at for s, f in (("low", F.min), ("high", F.max))])
        asks = left.withColumn("_block", F.explode(F.sequence(F.floor((F.col(n) + low + 1) / width), F.floor((F.col(n) + low + width) / width))))
        may = asks.join(bounds, [*by, "_block"]).filter(could(lambda c: F.col(f"_low_{c}"), lambda c: F.col(f"_high_{c}"))).select(asks.columns)
        inside = (F.col(f"_o_{n}") > F.col(n) + low) & (F.col(f"_o_{n}") <= F.col(n) + low + width)
        met = may.join(block, [*by, "_block"]).filter(inside & far(lambda c: F.col(f"_o_{c}")))
        now = cut(met.groupBy(*by, n).agg(F.min(f"_o_{n}").alias("next")))
        found = now if found is None else found.union(now)
        left = cut(left.join(now, [*by, n], "left_anti").filter(F.col(n) + low + width < F.col("_last")))
        low, width = low + width, 2 * width
    return found if found is not None else rows.select(*by, n, F.col(n).alias("next")).limit(0)


def reached(links: DataFrame, by: Sequence[str], n: str, start: DataFrame) -> DataFrame:
    """(by, n) of the rows that `start` (by, n) reaches along `links` (by, n, next), itself included.

    Each round doubles how far links lead, and adds what those reached so far lead to: log2 of the longest chain.
    """
    seen, jump = start.select(*by, n), cut(links.select(*by, n, "next"))
    while True:
        step = cut(seen.join(jump, [*by, n]).select(*by, F.col("next").alias(n)))
        if step.isEmpty():
            return seen
        seen = cut(seen.union(step))
        onward = jump.select(*by, F.col(n).alias("next"), F.col("next").alias("_then"))
        jump = cut(jump.join(onward, [*by, "next"]).select(*by, n, F.col("_then").alias("next")))


def _kept(rows: DataFrame, by: Sequence[str], links: DataFrame) -> DataFrame:
    start = rows.groupBy(*by).agg(F.min("n").alias("n"))
    return rows.join(reached(links, by, "n", start), [*by, "n"])


def _apart(at: Sequence[str], o: Callable[[str], Column]) -> Column:
    return F.sqrt(sum(((o(c) - F.col(c)) ** 2 for c in at), F.lit(0.0)))


def _reach(at: Sequence[str], low: Callable[[str], Column], high: Callable[[str], Column]) -> Column:
    """How far the farthest corner of a block is."""
    return F.sqrt(sum((F.greatest(F.abs(low(c) - F.col(c)), F.abs(high(c) - F.col(c))) ** 2 for c in at), F.lit(0.0)))


def resampled(rows: DataFrame, by: Sequence[str], order: str, cell: Column, at: Sequence[str], spacing: float) -> DataFrame:
    """Rows of each walk kept in order: the first, then each at least `spacing` from the last kept one."""
    rows = cut(numbered(rows, by, order, cell))
    # Bounds that rounding makes a little too small must not hide a row.
    links = followed_by(rows, by, "n", at, lambda o: _apart(at, o) >= spacing, lambda low, high: _reach(at, low, high) >= spacing * (1 - 1e-9))
    return _kept(rows, by, links).drop("n")


def keyframes(rows: DataFrame, by: Sequence[str], order: str, cell: Column, time: str, at: Sequence[str], least_gap: float, most_gap: float, least_move: float) -> DataFrame:
    """Rows of each walk kept in order: the first, then each `most_gap` after the last kept one, or `least_gap` after it and moved by `least_move`."""
    rows = cut(numbered(rows, by, order, cell))

    def far(o):
        gap = o(time) - F.col(time)
        return (gap >= most_gap) | ((gap >= least_gap) & (_apart(at, o) >= least_move))

    def could(low, high):
        gap = high(time) - F.col(time)
        return (gap >= most_gap) | ((gap >= least_gap) & (_reach(at, low, high) >= least_move * (1 - 1e-9)))

    return _kept(rows, by, followed_by(rows, by, "n", [time, *at], far, could)).drop("n")


#: Look distances along a path, in its unit, and the chord ratio of a turn: fixed values.
LOOKS, CHORD_RATIO = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0), 0.65


def sharpest_turns(rows: DataFrame, by: Sequence[str], order: str, cell: Column, at: Sequence[str] = ("x", "y"), looks: Sequence[float] = LOOKS, ratio: float = CHORD_RATIO, chunk: float = 4.0) -> DataFrame:
    """(by, order, degrees): the row of each walk where its direction turns most, seen over some look distance.

    The directions are those from the first row at most a look before, and to the first at least a look after, by arc
    length; between them the chord must be at most `ratio` of the arc. Turns equal to the billionth of a degree go to
    the shorter look, then to the earlier row. Chunks are `chunk` of arc long and overlap by the longest look; work in
    a chunk grows with the rows within a look.
    """
    x = [F.col(c) for c in at]
    rows = cut(numbered(rows, by, order, cell))
    # Where a step begins lies in the row before it, which may be of another cell.
    after = rows.select(*by, (F.col("n") + 1).alias("n"), *[F.col(c).alias(f"_p_{c}") for c in at])
    stepped = rows.join(after, [*by, "n"], "left").withColumn("_step", F.coalesce(F.sqrt(sum(((c - F.col(f"_p_{a}")) ** 2 for c, a in zip(x, at, strict=True)), F.lit(0.0))), F.lit(0.0)))
    arc = cut(running_totals(stepped.withColumn("_cell", F.floor(F.col("n") / 4096)), by, "_cell", "n", {"_step": "arc"}).select(*by, order, "n", *at, "arc"))
    ends = arc.groupBy(*by).agg(F.max("arc").alias("_end"), F.max("n").alias("_last"))
    most = max(looks)
    home = F.floor(F.col("arc") / chunk)
    spread = arc.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(F.floor((F.col("arc") - most) / chunk), F.floor((F.col("arc") + most) / chunk))))
    spread = spread.join(ends, list(by))
    quoted = lambda some: ", ".join(f"`{c}`" for c in some)
    # A row at an arc length has the smallest number of those that share it.
    first = lambda low, high: F.expr(f"min(struct({quoted(['n', 'arc', *at])})) over (partition by {quoted([*by, '_chunk'])} order by arc range between {low} and {high})")
    looked = {f"_b{i}": first(f"{look}D preceding", "current row") for i, look in enumerate(looks)}
    seen = spread.withColumns(looked | {f"_a{i}": first(f"{look}D following", "unbounded following") for i, look in enumerate(looks)})
    own = seen.filter((F.col("_home") == F.col("_chunk")) & (F.col("n") > 1) & (F.col("n") < F.col("_last")))
    turns = []
    for i, look in enumerate(looks):
        b, a = F.col(f"_b{i}"), F.col(f"_a{i}")
        before, then = [c - b[k] for c, k in zip(x, at, strict=True)], [a[k] - c for c, k in zip(x, at, strict=True)]
        size = lambda v: F.sqrt(sum((c * c for c in v), F.lit(0.0)))
        sizes = size(before) * size(then)
        chord = size([a[k] - b[k] for k in at])
        ok = (F.col("arc") >= look) & a.isNotNull() & (sizes > 0) & (chord <= ratio * (a["arc"] - b["arc"]))
        cosine = F.try_divide(sum((p * q for p, q in zip(before, then, strict=True)), F.lit(0.0)), sizes)
        turns.append(F.when(ok, F.struct(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("degrees"), F.lit(i).alias("look"))))
    told = own.select(*by, order, "n", F.explode(F.array(*turns)).alias("t")).filter("t is not null")
    best = told.groupBy(*by).agg(F.min(F.struct(-F.round("t.degrees", 9), "t.look", "n", order)).alias("m"))
    return best.select(*by, F.col(f"m.{order}").alias(order), (-F.col("m.col1")).alias("degrees"))
