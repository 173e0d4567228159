"""Queries of rule packs, ledgers, calls and answers."""

import json

from pyspark.sql import functions as F

from plumbline.plans import answers, catalogue, packs
from plumbline.plans.queries_plans import REGIONS, WORDS, _elements
from plumbline.registry import query
from plumbline.tables import table

#: A pack and a ledger as their files hold them; one threshold changed since it was verified, one rule has no entry.
PACK = {
    "version": "2",
    "rules": [
        {"id": "route_clear_width", "citation": {"section": "403.5.1"}, "threshold": 36.0, "words": "route"},
        {"id": "door_clear_width", "citation": {"section": "404.2.3"}, "threshold": 815.0, "unit": "mm", "words": "door"},
        {"id": "counter_height", "citation": {"section": "904.4"}, "threshold": 36.0, "comparison": "at_most", "words": "counter", "measure": "top_m"},
        {"id": "protruding_objects", "citation": {"section": "307.2"}, "threshold": 4.0, "comparison": "at_most", "words": "sign", "measure": "depth_m", "when": {"measure": "bottom_m", "comparison": "at_least", "limit": 0.6858}},
        {"id": "reach_range", "citation": {"section": "308.2"}, "threshold": 48.0, "comparison": "at_most", "words": "control", "measure": "top_m"},
        {"id": "grab_bars", "citation": {"section": "604.5"}, "threshold": 42.0, "words": "bar"},
        {"id": "later", "citation": {"section": "1"}, "tier": 2, "threshold": 1.0, "words": "route"},
    ],
}
LEDGER = {
    "entries": [
        {"rule_id": "route_clear_width", "section": "403.5.1", "threshold": 36.0, "unit": "in", "verified_by": "p"}, {"rule_id": "door_clear_width", "section": "404.2.3", "threshold": 815.0, "unit": "mm", "verified_by": "p"},
        {"rule_id": "counter_height", "section": "904.4", "threshold": 36.0, "unit": "in", "verified_by": "p"}, {"rule_id": "protruding_objects", "section": "307.2", "threshold": 4.0, "unit": "in", "verified_by": "p"},
        {"rule_id": "reach_range", "section": "308.2", "threshold": 54.0, "unit": "in", "verified_by": "p"}, {"rule_id": "route_clear_width", "section": "403.5.1", "threshold": 36.0, "unit": "in", "verified_by": "q"},
    ]
}


def _rules(spark):
    pack, ledger = (spark.createDataFrame([(json.dumps(x),)], "doc string") for x in (PACK, LEDGER))
    return packs.with_verification(packs.parse_pack(pack), packs.parse_ledger(ledger))


@query("verified_rules", f"""WITH r AS (SELECT * FROM (VALUES ('route_clear_width', true, 'route'), ('door_clear_width', true, 'door'), ('counter_height', true, 'counter'), ('protruding_objects', true, 'sign'), ('reach_range', false, 'control'), ('grab_bars', false, 'bar')) t(id, verified, words)),
    e AS (SELECT list_extract({WORDS}, (p_partkey % 9 + 1)::INT) AS w FROM part) SELECT id, verified, (SELECT count(*) FROM e WHERE contains(w, words)) AS n FROM r""")
def verified_rules(spark, sf_dir):
    """A pack's rules, whether the ledger verifies each with its present threshold, and how many elements it is for."""
    rules, elements = _rules(spark), _elements(spark, sf_dir)
    tally = elements.groupBy(F.lower("label").alias("_label")).agg(F.count("*").alias("n"))
    n = packs.fitting(rules, elements).join(tally, "_label").groupBy("_words").agg(F.sum("n").alias("n"))
    return rules.withColumn("_words", F.lower("words")).join(n, "_words", "left").select("id", "verified", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("pack_outcomes", f"""WITH e AS (SELECT *, list_extract({WORDS}, (id % 9 + 1)::INT) AS w FROM ({REGIONS})), m AS (
    SELECT 'route_clear_width' AS rule_id, id, width_m::DOUBLE / 0.0254 AS v, 36.0::DOUBLE AS t, true AS least FROM e WHERE contains(w, 'route') UNION ALL SELECT 'door_clear_width', id, width_m::DOUBLE / 0.0254, 0.815::DOUBLE / 0.0254, true FROM e WHERE contains(w, 'door')
    UNION ALL SELECT 'counter_height', id, top_m::DOUBLE / 0.0254, 36.0, false FROM e WHERE contains(w, 'counter') UNION ALL SELECT 'protruding_objects', id, depth_m::DOUBLE / 0.0254, 4.0, false FROM e WHERE contains(w, 'sign') AND bottom_m::DOUBLE >= 0.6858 - 1e-6)
    SELECT rule_id, outcome, count(*) AS n, min(id) AS first FROM (SELECT rule_id, id, CASE WHEN least AND v - 0.25 >= t - 1e-6 THEN 'passes' WHEN least AND v + 0.25 < t - 1e-6 THEN 'problem' WHEN NOT least AND v + 0.25 <= t + 1e-6 THEN 'passes'
    WHEN NOT least AND v - 0.25 > t + 1e-6 THEN 'problem' ELSE 'question' END AS outcome FROM m) GROUP BY ALL UNION ALL SELECT 'reach_range', 'question', 1, NULL UNION ALL SELECT 'grab_bars', 'question', 1, NULL""")
def pack_outcomes(spark, sf_dir):
    """Rules from data over measured elements."""
    found = packs.evaluate(_elements(spark, sf_dir), _rules(spark), uncertainty=0.25)
    return found.groupBy("rule_id", "outcome").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("judged_calls", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'unknown name weigh' WHEN p_partkey % 6 = 1 THEN NULL WHEN p_partkey % 6 = 2 THEN 'missing axis' WHEN p_partkey % 6 = 3 THEN 'unknown colour' WHEN p_partkey % 6 = 4 THEN 'arguments are no object' ELSE 'missing other, piece' END AS refused FROM part""")
def judged_calls(spark, sf_dir):
    """Calls against the catalogue, refused with a reason before anything runs."""
    k = F.col("p_partkey")
    pick = lambda *some: F.coalesce(*[F.when(k % 6 == i, F.lit(v)) for i, v in enumerate(some)])
    name = pick("weigh", "height_of", "size_of", "height_of", "height_of", "distance_between")
    arguments = pick('{"piece": 1}', '{"piece": 7}', '{"piece": 1, "axis": null}', '{"piece": 1, "colour": "red"}', "seven", "{}")
    return catalogue.judged_calls(table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), arguments.alias("arguments"))).select("p_partkey", "refused")


@query("answers_grounded")
def answers_grounded(spark, sf_dir):
    """An answer's figures, each of which must be stated in the turn before it, in any unit; whole texts.

    Without a figure there is nothing to refuse. Tests compare it with a loop over turns.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    both = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    bad = answers.invented(F.col("text"), answers.stated(F.col("asked")))
    return both.select("conv_id", "turn", F.size(answers.figures(F.col("text"))).alias("n_figures"), F.size(bad).alias("n_invented"), (F.size(bad) == 0).alias("grounded"))


@query("stated_quantities", """WITH q AS (SELECT p_partkey, p_size AS s, 'leave ' || p_size || ' cm, or two half steps and a twenty-five' AS asked, p_partkey % 4 AS r FROM part), g AS (SELECT p_partkey, s, CASE r WHEN 0 THEN s / 100 WHEN 1 THEN s * 0.3048::DOUBLE WHEN 2 THEN 1.0 ELSE 77.7 END AS v FROM q)
    SELECT p_partkey, len(list_filter(list_transform([s, 2, 0.5, 1, 20, 2 * 0.5], lambda n: list_sum(list_transform([1, 0.01, 0.001, 0.0254, 0.3048], lambda k: (abs(v - n::DOUBLE * k::DOUBLE) <= greatest(abs(v) * 0.02::DOUBLE, 1e-6))::INT))), lambda x: x > 0)) > 0 AS stated FROM g""")
def stated_quantities(spark, sf_dir):
    """a plan's number must stand in the question, in digits or words, at some scale."""
    k, s = F.col("p_partkey"), F.col("p_size")
    asked = F.concat(F.lit("leave "), s.cast("string"), F.lit(" cm, or two half steps and a twenty-five"))
    value = F.when(k % 4 == 0, s / 100).when(k % 4 == 1, s * 0.3048).when(k % 4 == 2, 1.0).otherwise(77.7)
    return table(spark, sf_dir, "part").select("p_partkey", answers.accounted(value, answers.stated(asked)).alias("stated"))
