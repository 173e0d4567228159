"""Data-driven rules: select elements, optionally where a condition holds, measure each, and give a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X


@dataclass(frozen=True)
class Rule:
    """A rule over elements. threshold is in `unit`; a rule without a verified threshold is held, not passed.

    when: (measure, comparison, limit in metres) that an element must meet for the rule to apply.
    """

    rule_id: str
    words: str
    measure: str
    comparison: str
    threshold: float | None
    unit: str = "in"
    when: tuple[str, str, float] | None = None
    verified: bool = True
    tier: int = 1


#: Rules of the measured-space checks that the verification ledger gives a limit for: fixed values.
RULES = [
    Rule("route_clear_width", "route", "width_m", "at_least", 36.0),
    Rule("door_clear_width", "door", "width_m", "at_least", 32.0),
    Rule("turning_space", "turn", "width_m", "at_least", 60.0),
    Rule("service_counter_height", "counter", "top_m", "at_most", 36.0),
    Rule("dining_surface_low", "table", "top_m", "at_least", 28.0),
    Rule("dining_surface_high", "table", "top_m", "at_most", 34.0),
    Rule("reach_range", "control", "top_m", "at_most", 48.0),
    Rule("protruding_objects", "sign", "depth_m", "at_most", 4.0, when=("bottom_m", "at_least", 27 * X.INCH)),
    Rule("grab_bars", "bar", "width_m", "at_least", None, verified=False),
]


def evaluate(elements: DataFrame, rules: list[Rule], uncertainty: float = 0.0, max_tier: int = 2) -> DataFrame:
    """(rule_id, id, outcome, measured_inches, required_inches, shortfall) of each enabled rule and element.

    outcome: passes, problem, or question (no measure, or the uncertainty in inches straddles the limit). Rules
    without verification give one question row without an element.
    """
    enabled = [r for r in rules if r.tier <= max_tier]
    held = [r.rule_id for r in enabled if not r.verified or r.threshold is None]
    entries = []
    for r in enabled:
        if r.rule_id in held:
            continue
        applies = X.name_has_words(F.col("label"), r.words)
        if r.when:
            applies &= X.meets(F.col(r.when[0]), r.when[1], F.lit(r.when[2]))
        limit = X.inches(X.in_metres(F.lit(r.threshold), F.lit(r.unit)))
        measured = X.inches(F.col(r.measure))
        head = "min" if r.comparison == "at_least" else "max"
        verdict = X.interval_verdict(measured - uncertainty, measured + uncertainty, limit, head, eps=X.AT_LIMIT)
        outcome = F.when(verdict == "satisfied", "passes").when(verdict == "violation", "problem").otherwise("question")
        short = F.greatest(F.lit(0.0), limit - measured if head == "min" else measured - limit)
        one = F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.col("id").cast("long").alias("id"), outcome.alias("outcome"), measured.alias("measured_inches"),
            limit.alias("required_inches"), short.alias("shortfall"),
        )
        entries.append(F.when(applies, one))
    # All rules in one pass over the elements.
    judged = elements.select(F.explode(F.array_compact(F.array(*entries))).alias("r")).select("r.*")
    rows = [(rule, None, "question", None, None, None) for rule in held]
    return judged.union(elements.sparkSession.createDataFrame(rows, "rule_id string, id long, outcome string, measured_inches double, required_inches double, shortfall double"))


def reduced_width(runs: DataFrame, keys: list[str], limit: float = 32.0, longest: float = 24.0, apart: float = 48.0) -> DataFrame:
    """Verdict of each route whose runs below the full width are (start, end, width), all in inches.

    A route may narrow to `limit` over runs of at most `longest` that lie `apart` from each other.
    """
    from plumbline.operators.seq import separations

    judged = separations(runs, keys, "start", "end")
    bad = (F.col("width") < limit - X.AT_LIMIT) | (F.col("end") - F.col("start") > longest + X.AT_LIMIT) | (F.col("to_next") < apart - X.AT_LIMIT)
    return judged.groupBy(*keys).agg(F.when(F.bool_or(F.coalesce(bad, F.lit(False))), "problem").otherwise("passes").alias("outcome"))
