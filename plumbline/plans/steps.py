"""A small step-by-step plan over regions, compiled to one lazy DataFrame.

A plan is a list of steps, each a dict with `id` and `op`, that name earlier steps by id. Steps that give regions
are DataFrames with the region columns; steps that give a number are DataFrames of one row with `value`. Nothing
runs until the result is read. Errors in a plan are raised when it is compiled, and errors in its data when it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X

FIELDS = ("width_m", "depth_m", "height_m", "footprint_m2", "bottom_m", "top_m", "x_m", "y_m", "z_m")
NUMBERS = ("value", "arith", "count", "sum", "extreme", "compare", "given")
OPS = ("every", "regions", "without", "where", "pick", "nearest", *NUMBERS)


class PlanError(ValueError):
    """A step that can't be compiled."""


def _field(step: dict) -> Column:
    if step.get("field") not in FIELDS:
        raise PlanError(f"step {step['id']}: unknown field {step.get('field')!r}")
    return F.col(step["field"])


def compile_plan(regions: DataFrame, steps: list[dict]) -> DataFrame:
    """The last step's result. regions: id, label and FIELDS, one row each."""
    done: dict[str, tuple[str, DataFrame]] = {}

    def of(step: dict, name: str, kind: str) -> DataFrame:
        ref = step.get(name)
        if ref not in done:
            raise PlanError(f"step {step['id']}: {name} names no earlier step: {ref!r}")
        if done[ref][0] != kind:
            raise PlanError(f"step {step['id']}: {name} must give {kind}")
        return done[ref][1]

    for step in steps:
        if step["op"] not in OPS:
            raise PlanError(f"step {step['id']}: unknown operation {step['op']!r}")
        if step["id"] in done:
            raise PlanError(f"step {step['id']} occurs twice")
        kind = "number" if step["op"] in NUMBERS else "regions"
        done[step["id"]] = (kind, _compiled(regions, step, of))
    if not steps:
        raise PlanError("a plan needs a step")
    return done[steps[-1]["id"]][1]


def _compiled(regions: DataFrame, step: dict, of) -> DataFrame:
    op = step["op"]
    if op == "every":
        return regions
    if op == "regions":
        return regions.filter(F.col("id").isin(list(step["ids"]))) if "ids" in step else regions.filter(X.name_has_words(F.col("label"), step["value"]))
    if op == "without":
        return of(step, "of", "regions").join(of(step, "other", "regions").select("id"), "id", "left_anti")
    if op == "where":
        limit = of(step, "other", "number").select(F.col("value").alias("_limit"))
        kept = of(step, "of", "regions").join(F.broadcast(limit))  # one row
        return kept.filter(X.compared(_field(step), step["how"], F.col("_limit"))).drop("_limit")
    if op == "pick":
        order = F.desc(step["field"]) if step["how"] == "max" else F.asc(step["field"])
        _field(step)
        return of(step, "of", "regions").orderBy(order, "id").limit(1)
    if op == "nearest":
        anchor = of(step, "other", "regions").select(F.col("x_m").alias("_x"), F.col("y_m").alias("_y"), F.col("z_m").alias("_z"), F.col("id").alias("_id"))
        floor = step.get("field") == "floor"
        d = F.sqrt((F.col("x_m") - F.col("_x")) ** 2 + (F.col("y_m") - F.col("_y")) ** 2 + (F.lit(0.0) if floor else (F.col("z_m") - F.col("_z")) ** 2))
        near = of(step, "of", "regions").join(F.broadcast(_single(anchor, step))).filter("id <> _id")  # one row
        order = F.desc("_d") if step.get("how") == "max" else F.asc("_d")
        return near.withColumn("_d", d).orderBy(order, "id").limit(1).drop("_x", "_y", "_z", "_id", "_d")
    if op == "given":
        return regions.sparkSession.range(1).select(F.lit(float(step["value"])).alias("value"))
    if op == "count":
        return of(step, "of", "regions").agg(F.count("*").cast("double").alias("value"))
    if op == "sum":
        return of(step, "of", "regions").agg(F.coalesce(F.sum(_field(step)), F.lit(0.0)).alias("value"))
    if op == "extreme":
        return of(step, "of", "regions").agg((F.max if step["how"] == "max" else F.min)(_field(step)).alias("value"))
    if op == "value":
        return _single(of(step, "of", "regions").select(_field(step).alias("value")), step)
    a = of(step, "of", "number").select(F.col("value").alias("_a"))
    both = a.join(F.broadcast(of(step, "other", "number").select(F.col("value").alias("_b"))))  # one row each
    x, y = F.col("_a"), F.col("_b")
    if op == "compare":
        return both.select(X.three_way(x, y).cast("double").alias("value"))
    results = {"add": x + y, "sub": x - y, "mul": x * y, "ratio": F.when(y != 0, x / y).otherwise(F.raise_error(F.lit("ratio to zero")).cast("double")), "gap": F.abs(x - y)}
    if step["how"] not in results:
        raise PlanError(f"step {step['id']}: unknown arithmetic {step['how']!r}")
    return both.select(results[step["how"]].alias("value"))


def _single(rows: DataFrame, step: dict) -> DataFrame:
    """The only row, or an error when it runs; at most two rows are gathered."""
    whole = F.struct(*rows.columns)
    one = rows.limit(2).agg(F.count("*").alias("_n"), F.first(whole).alias("_r"))
    checked = one.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"step {step['id']} needs exactly one region")))
    return checked.filter("_ok is null").select("_r.*")
