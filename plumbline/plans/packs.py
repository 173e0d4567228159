"""Rule packs and verification ledgers as data: JSON documents, rows, and rules over measured elements.

A pack is {version, rules: [{id, title, citation: {section}, tier, threshold, unit, comparison, words, measure, when}]};
a ledger is {entries: [{rule_id, section, threshold, unit, verified_by}]}. Both are small; the elements that rules are
evaluated on aren't: labels are found by an index of words, and rules, whose number is checked, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators.containment import all_words_in

RULES = """struct<version: string, rules: array<struct<id: string, title: string, citation: struct<section: string>, tier: int, threshold: double, unit: string, comparison: string,
    words: string, measure: string, `when`: struct<measure: string, comparison: string, limit: double>>>>"""
ENTRIES = "struct<entries: array<struct<rule_id: string, section: string, threshold: double, unit: string, verified_by: string>>>"
#: Thresholds closer than this are one; rules of a pack, at most; measures that a rule may name. Fixed values.
SAME_THRESHOLD, MOST_RULES = 1e-9, 1_000
MEASURES = ("width_m", "depth_m", "height_m", "bottom_m", "top_m")


def parse_pack(docs: DataFrame) -> DataFrame:
    """(version, id, title, section, tier, threshold, unit, comparison, words, measure, when) from documents (doc).

    What a rule leaves out is tier 1, inches, at_least, and the width. A rule id that a version defines twice, a rule
    without an id or a comparison or measure that isn't known is an error when the rows are read.
    """
    read = docs.select(F.from_json("doc", RULES).alias("p")).select("p.version", F.inline("p.rules"))
    rows = read.select(
        "version", "id", "title", F.col("citation.section").alias("section"), F.coalesce("tier", F.lit(1)).alias("tier"), "threshold", F.coalesce("unit", F.lit("in")).alias("unit"),
        F.coalesce("comparison", F.lit("at_least")).alias("comparison"), F.coalesce("words", "id").alias("words"), F.coalesce("measure", F.lit("width_m")).alias("measure"), "when",
    )
    times = rows.groupBy("version", "id").agg(F.count("*").alias("n"), F.first(F.struct(*[c for c in rows.columns if c not in ("version", "id")])).alias("r"))
    bad = (
        F.when(F.col("id").isNull(), "a rule without an id")
        .when(F.col("n") > 1, F.concat(F.lit("two rules share the id "), "id", F.lit(" in version "), F.coalesce("version", F.lit("without a name"))))
        .when(~F.col("r.comparison").isin("at_least", "at_most"), F.concat(F.lit("unknown comparison of "), "id"))
        .when(~F.col("r.measure").isin(*MEASURES), F.concat(F.lit("unknown measure of "), "id"))
    )
    return times.withColumn("id", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("id"))).select("version", "id", "r.*")


def parse_ledger(docs: DataFrame) -> DataFrame:
    """(rule_id, section, threshold, unit, verified_by) from documents (doc)."""
    return docs.select(F.from_json("doc", ENTRIES).alias("l")).select(F.inline("l.entries"))


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    return parse_pack(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger that isn't there verifies nothing."""
    try:
        return parse_ledger(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "rule_id string, section string, threshold double, unit string, verified_by string")


def with_verification(pack: DataFrame, ledger: DataFrame, max_tier: int = 1) -> DataFrame:
    """Rules up to a tier with verified: an entry has the rule's section and unit, and its threshold.

    So a rule whose threshold changed since is unverified again. Entries of a rule are one row first.
    """
    e = ledger.select(F.col("rule_id").alias("id"), "section", "unit", F.col("threshold").alias("_t"))
    hits = pack.join(e, ["id", "section", "unit"]).filter(F.abs(F.col("_t") - F.col("threshold")) <= SAME_THRESHOLD).select("version", "id").distinct().withColumn("verified", F.lit(True))
    return pack.filter(F.col("tier") <= max_tier).join(hits, ["version", "id"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def fitting(rules: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct (_words, _label), in lower case: a rule's words that are all in a label of an element; no words fit all."""
    words, labels = rules.select(F.lower("words").alias("_words")).distinct(), elements.select(F.lower("label").alias("_label")).distinct()
    every = words.filter(F.trim("_words") == "").crossJoin(labels.filter("_label is not null"))
    return all_words_in(words, labels, "_words", "_label").union(every)


def evaluate(elements: DataFrame, rules: DataFrame, uncertainty: float = 0.0) -> DataFrame:
    """(rule_id, id, outcome, measured, required) of each verified rule and the elements (id, label, measures) it is for.

    outcome: passes, problem, or question where the uncertainty, in inches, straddles the limit, the measure is
    missing or the unit unknown. An unverified rule gives one question row without an element.
    """
    some = rules.limit(MOST_RULES + 1).count()
    if some > MOST_RULES:
        raise ValueError(f"a pack has at most {MOST_RULES} rules")
    of = lambda name: F.coalesce(*[F.when(name == m, F.col(m).cast("double")) for m in MEASURES])
    meets = lambda value, how, limit: F.when(how == "at_least", X.meets(value, "at_least", limit)).otherwise(X.meets(value, "at_most", limit))
    applies = F.col("when").isNull() | F.coalesce(meets(of(F.col("when.measure")), F.col("when.comparison"), F.col("when.limit")), F.lit(False))
    measured = X.inches(of(F.col("measure")))
    limit = X.inches(X.in_metres(F.col("threshold"), F.col("unit")))
    verdict = lambda head: X.interval_verdict(measured - uncertainty, measured + uncertainty, limit, head, eps=X.AT_LIMIT)
    how: Column = F.when(F.col("comparison") == "at_least", verdict("min")).otherwise(verdict("max"))
    outcome = F.when(how == "satisfied", "passes").when(how == "violation", "problem").otherwise("question")
    kept = rules.filter("verified").drop("title", "section", "tier", "version").withColumnRenamed("id", "rule_id").withColumn("_words", F.lower("words"))
    named = elements.withColumn("_label", F.lower("label")).join(fitting(kept, elements), "_label")
    judged = named.join(F.broadcast(kept), "_words").filter(applies).select("rule_id", F.col("id").cast("long").alias("id"), outcome.alias("outcome"), measured.alias("measured"), limit.alias("required"))
    held = rules.filter("not verified").select(F.col("id").alias("rule_id"), F.lit(None).cast("long").alias("id"), F.lit("question").alias("outcome"), F.lit(None).cast("double").alias("measured"), F.lit(None).cast("double").alias("required"))
    return judged.union(held)
