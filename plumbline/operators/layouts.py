"""Layout changes: hard constraints, gates, rewards, usability, grids of experiments, and how runs end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.seq import in_order
from plumbline.operators.spatial import within

#: Rewards: weights of parts and the least reward of an accepted layout. Fixed values.
WEIGHTS, LEAST_REWARD = {"shortfall": 0.6, "usability": 0.4}, 0.05


def violations(before: DataFrame, after: DataFrame, most_move: float, room: tuple[float, float]) -> DataFrame:
    """(id, violation) of pieces (id, x, y, width, depth, movable) that a new layout treats as it may not.

    locked_move, resized, removed, added, off_floor, too_far; several a piece are several rows.
    """
    a = after.select("id", *[F.col(c).alias(f"n_{c}") for c in ("x", "y", "width", "depth")], F.lit(True).alias("_after"))
    both = before.withColumn("_before", F.lit(True)).join(a, "id", "full")
    move = F.sqrt((F.col("n_x") - F.col("x")) ** 2 + (F.col("n_y") - F.col("y")) ** 2)
    outside = (F.col("n_x") - F.col("n_width") / 2 < 0) | (F.col("n_y") - F.col("n_depth") / 2 < 0) | (F.col("n_x") + F.col("n_width") / 2 > room[0]) | (F.col("n_y") + F.col("n_depth") / 2 > room[1])
    tests = {
        "removed": F.col("_after").isNull(),
        "added": F.col("_before").isNull(),
        "locked_move": ~F.col("movable") & (move > 1e-6),
        "resized": (F.abs(F.col("n_width") - F.col("width")) > 1e-6) | (F.abs(F.col("n_depth") - F.col("depth")) > 1e-6),
        "off_floor": outside & (move > 1e-6),
        "too_far": move > most_move,
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    return both.select("id", F.explode(named).alias("violation"))


def collisions(pieces: DataFrame, reach: float, group: str | None = None) -> DataFrame:
    """(id, other) of axis-aligned pieces (id, x, y, width, depth), of a group if named, that overlap.

    No piece is larger than `reach`.
    """
    # A piece takes its measures along, so pairs aren't joined to them again.
    whole = pieces.select(*([group] if group else []), F.struct("id", "x", "y", "width", "depth").alias("_p"), "x", "y")
    near = within(whole, whole, "_p", ["x", "y"], reach, group=group).filter(F.col("_p.id") < F.col("other.id"))
    over = lambda p, s: F.abs(F.col(f"_p.{p}") - F.col(f"other.{p}")) < (F.col(f"_p.{s}") + F.col(f"other.{s}")) / 2 - 1e-9
    return near.filter(over("x", "width") & over("y", "depth")).select("_p.id", F.col("other.id").alias("other"))


def usability(now: str, before: str) -> Column:
    """Aggregate: the mean over affected pieces of min(1, now / before), 1 when none is, to six places."""
    share = F.when(F.col(before) > 0, F.least(F.lit(1.0), F.col(now) / F.col(before)))
    return F.round(F.coalesce(F.avg(share), F.lit(1.0)), 6)


def reward(accepted: Column, recovered: Column, usable: Column) -> Column:
    """0 for what the gate refuses; else the weighted parts, clipped, at least LEAST_REWARD, to six places."""
    parts = WEIGHTS["shortfall"] * recovered + WEIGHTS["usability"] * usable
    return F.round(F.when(accepted, F.greatest(F.lit(LEAST_REWARD), F.least(F.lit(1.0), parts))).otherwise(0.0), 6)


def pins(pieces: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """`pieces` with pinned_for: every reason whose test fires, joined by commas; null where none does."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in reasons.items()]))
    return pieces.withColumn("pinned_for", F.when(F.size(fired) > 0, F.array_join(fired, ",")))


def experiment_grid(cases: DataFrame, knobs: dict[str, Sequence[float]]) -> DataFrame:
    """Every case with every setting of the knobs, which are few: settings are expanded inside the row."""
    out = cases
    for name, values in knobs.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def better_run(scores: DataFrame, guarded: str) -> DataFrame:
    """(accepted, gain): from rows (case_id, scorer, old, new), on cases scored in both runs.

    Accepted when no scorer's total falls, the summed gain is positive, and the guarded error doesn't rise.
    """
    both = scores.filter("old is not null and new is not null")
    totals = both.groupBy("scorer").agg(F.sum("old").alias("o"), F.sum("new").alias("n"))
    is_guard = F.col("scorer") == guarded
    falls = F.coalesce(F.bool_or(~is_guard & (F.col("n") < F.col("o") - 1e-9)), F.lit(False))
    rises = F.coalesce(F.bool_or(is_guard & (F.col("n") > F.col("o") + 1e-9)), F.lit(False))
    gain = F.coalesce(F.sum(F.when(~is_guard, F.col("n") - F.col("o"))), F.lit(0.0))
    return totals.agg(gain.alias("gain"), (~falls & ~rises & (gain > 1e-9)).alias("accepted"))


def how_runs_end(steps: DataFrame, most: int, failures: int) -> DataFrame:
    """(run, ended, passes): done, rejected, stalled (an action repeated on the same state), failing, or out of passes.

    steps: run, pass, action, state, ok. The first reason in a run ends it.
    """
    w = W.partitionBy("run").orderBy("pass")
    stalled = F.coalesce((F.lag("action").over(w) == F.col("action")) & (F.lag("state").over(w) == F.col("state")), F.lit(False))
    failed = F.sum((~F.col("ok")).cast("int")).over(w) >= failures
    reason = (
        F.when(F.col("action") == "done", "done").when(F.col("action") == "reject", "rejected").when(stalled, "stalled").when(failed, "failing").when(F.col("pass") >= most, "passes")
    )
    ends = steps.withColumn("ended", reason).filter("ended is not null").groupBy("run").agg(F.min(F.struct("pass", "ended")).alias("x"))
    return ends.select("run", "x.ended", F.col("x.pass").alias("passes"))


def policy_verdict(measured: Column, hard_ok: Column, score: Column) -> Column:
    """rejected when a measured hard gate fails, blocked when evidence is missing, else the score as text."""
    return F.when(measured & ~hard_ok, "rejected").when(~measured, "blocked").otherwise(F.format_string("%.4f", score))


def near_duplicate_split(frames: DataFrame, key: str, order: Sequence[str], dt: float, distance: float, angle: float) -> DataFrame:
    """`frames` (at, x, y, heading) with duplicate: within all thresholds of the frame before it in order."""
    w = W.partitionBy(key).orderBy(*order)
    turn = F.abs(F.col("heading") - F.lag("heading").over(w)) % 360
    near = (
        (F.col("at") - F.lag("at").over(w) <= dt)
        & (F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2) <= distance)
        & (F.least(turn, 360 - turn) <= angle)
    )
    return frames.withColumn("duplicate", F.coalesce(near, F.lit(False)))


def picked_frames(frames: DataFrame, key: str, dt: float, distance: float, angle: float, most: int = 6) -> DataFrame:
    """(key, frame) of up to `most` frames a key (at, frame, x, y, heading), in order of time, then frame.

    A frame is picked if it is separated from every one picked before: later than `dt`, farther than `distance`, or
    turned by more than `angle`. A key's state is the frames picked so far.
    """
    from math import hypot

    def separated(a, b) -> bool:
        turn = abs(a.heading - b.heading) % 360
        return abs(a.at - b.at) > dt or hypot(a.x - b.x, a.y - b.y) > distance or min(turn, 360 - turn) > angle

    def step(picked: list, row):
        if len(picked) >= most or not all(separated(row, p) for p in picked):
            return None
        picked.append(row)
        return getattr(row, key), row.frame

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    return in_order(frames.select(key, "frame", "at", "x", "y", "heading"), key, ["at", "frame"], list, step, f"{key} {kinds[key]}, frame {kinds['frame']}")
