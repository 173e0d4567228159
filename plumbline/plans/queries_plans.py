"""Queries of the plan language and the rules."""

from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import seq
from plumbline.plans import rules, steps
from plumbline.registry import query
from plumbline.tables import table

REGIONS = """SELECT p_partkey AS id, p_type AS label, p_size / 10.0 AS width_m, (p_partkey % 13) / 10.0 AS depth_m, p_retailprice / 1000 AS height_m, p_size / 10.0 * ((p_partkey % 13) / 10.0) AS footprint_m2,
    (p_partkey % 3) / 2.0 AS bottom_m, (p_partkey % 3) / 2.0 + p_retailprice / 1000 AS top_m, (p_partkey % 60) / 10.0 AS x_m, (p_partkey % 80) / 10.0 AS y_m, (p_partkey % 3) / 2.0 AS z_m FROM part"""


def regions(spark, sf_dir):
    """Parts as measured regions."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_type").alias("label"), (size / 10.0).alias("width_m"), ((k % 13) / 10.0).alias("depth_m"), (F.col("p_retailprice") / 1000).alias("height_m"),
        (size / 10.0 * ((k % 13) / 10.0)).alias("footprint_m2"), ((k % 3) / 2.0).alias("bottom_m"), ((k % 3) / 2.0 + F.col("p_retailprice") / 1000).alias("top_m"),
        ((k % 60) / 10.0).alias("x_m"), ((k % 80) / 10.0).alias("y_m"), ((k % 3) / 2.0).alias("z_m"),
    )


@query("plan_count_wide", f"""WITH r AS ({REGIONS}) SELECT count(*)::DOUBLE AS value FROM r WHERE contains(lower(label), 'standard') AND width_m::DOUBLE > 2.5 AND id NOT IN (SELECT id FROM r WHERE depth_m::DOUBLE <= 0.3)""")
def plan_count_wide(spark, sf_dir):
    """Every, regions, where, without, count."""
    return steps.compile_plan(regions(spark, sf_dir), [
        {"id": "steel", "op": "regions", "value": "standard"}, {"id": "w", "op": "given", "value": 2.5}, {"id": "wide", "op": "where", "of": "steel", "field": "width_m", "how": "gt", "other": "w"},
        {"id": "all", "op": "every"}, {"id": "d", "op": "given", "value": 0.3}, {"id": "flat", "op": "where", "of": "all", "field": "depth_m", "how": "lte", "other": "d"},
        {"id": "left", "op": "without", "of": "wide", "other": "flat"}, {"id": "n", "op": "count", "of": "left"},
    ])


@query("plan_nearest_to_tallest", f"""WITH r AS ({REGIONS}), t AS (SELECT * FROM r ORDER BY height_m DESC, id LIMIT 1) SELECT r.id, r.label FROM r, t WHERE r.id <> t.id
    ORDER BY sqrt((r.x_m::DOUBLE - t.x_m::DOUBLE) ** 2 + (r.y_m::DOUBLE - t.y_m::DOUBLE) ** 2), r.id LIMIT 1""")
def plan_nearest_to_tallest(spark, sf_dir):
    """Q09, Q03: pick, nearest on the floor plane."""
    return steps.compile_plan(regions(spark, sf_dir), [
        {"id": "all", "op": "every"}, {"id": "tall", "op": "pick", "of": "all", "field": "height_m", "how": "max"},
        {"id": "near", "op": "nearest", "of": "all", "other": "tall", "field": "floor"},
    ]).select("id", "label")


@query("plan_ratio", f"""WITH r AS ({REGIONS}) SELECT round((SELECT max(height_m) FROM r) / (SELECT width_m::DOUBLE FROM r WHERE id = 7), 6) AS value""")
def plan_ratio(spark, sf_dir):
    """Extreme, value, arith."""
    return steps.compile_plan(regions(spark, sf_dir), [
        {"id": "all", "op": "every"}, {"id": "top", "op": "extreme", "of": "all", "field": "height_m", "how": "max"}, {"id": "one", "op": "regions", "ids": [7]},
        {"id": "w", "op": "value", "of": "one", "field": "width_m"}, {"id": "x", "op": "arith", "of": "top", "other": "w", "how": "ratio"},
    ]).select(F.round("value", 6).alias("value"))


@query("plan_compare_sums", f"""WITH r AS ({REGIONS}) SELECT CASE WHEN a < b THEN -1.0 ELSE 1.0 END::DOUBLE AS value FROM (SELECT coalesce(sum(footprint_m2::DOUBLE) FILTER (WHERE contains(lower(label), 'promo')), 0) AS a,
    coalesce(sum(footprint_m2::DOUBLE) FILTER (WHERE contains(lower(label), 'small')), 0) AS b FROM r)""")
def plan_compare_sums(spark, sf_dir):
    """Sum, compare."""
    return steps.compile_plan(regions(spark, sf_dir), [
        {"id": "a", "op": "regions", "value": "promo"}, {"id": "b", "op": "regions", "value": "small"},
        {"id": "sa", "op": "sum", "of": "a", "field": "footprint_m2"}, {"id": "sb", "op": "sum", "of": "b", "field": "footprint_m2"}, {"id": "c", "op": "compare", "of": "sa", "other": "sb"},
    ])


@query("region_measures", f"""WITH r AS ({REGIONS}) SELECT id, round(top_m::DOUBLE / 0.0254, 5) AS height_in, round(footprint_m2::DOUBLE / (0.0254 * 0.0254), 3) AS area_sq_in, round(greatest(0, 3.0 - top_m::DOUBLE) / 0.0254, 5) AS above_in FROM r""")
def region_measures(spark, sf_dir):
    """Heights, areas and the room left above."""
    r = regions(spark, sf_dir)
    return r.select("id", F.round(X.inches(F.col("top_m")), 5).alias("height_in"), F.round(F.col("footprint_m2") / (X.INCH * X.INCH), 3).alias("area_sq_in"), F.round(X.inches(F.greatest(F.lit(0.0), 3.0 - F.col("top_m"))), 5).alias("above_in"))


WORDS = ["route", "door", "turn", "counter", "table", "control", "sign", "bar", "chair"]


def _elements(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in WORDS])
    return regions(spark, sf_dir).withColumn("label", F.element_at(words, (F.col("id") % len(WORDS) + 1).cast("int")))


@query("rule_outcomes", f"""WITH e AS (SELECT *, list_extract({WORDS}, (id % 9 + 1)::INT) AS w FROM ({REGIONS})), m AS (
    SELECT 'route_clear_width' AS rule_id, id, width_m::DOUBLE / 0.0254 AS v, 36.0 AS t, true AS least FROM e WHERE w = 'route' UNION ALL SELECT 'door_clear_width', id, width_m::DOUBLE / 0.0254, 32.0, true FROM e WHERE w = 'door'
    UNION ALL SELECT 'turning_space', id, width_m::DOUBLE / 0.0254, 60.0, true FROM e WHERE w = 'turn' UNION ALL SELECT 'service_counter_height', id, top_m::DOUBLE / 0.0254, 36.0, false FROM e WHERE w = 'counter'
    UNION ALL SELECT 'dining_surface_low', id, top_m::DOUBLE / 0.0254, 28.0, true FROM e WHERE w = 'table' UNION ALL SELECT 'dining_surface_high', id, top_m::DOUBLE / 0.0254, 34.0, false FROM e WHERE w = 'table'
    UNION ALL SELECT 'reach_range', id, top_m::DOUBLE / 0.0254, 48.0, false FROM e WHERE w = 'control' UNION ALL SELECT 'protruding_objects', id, depth_m::DOUBLE / 0.0254, 4.0, false FROM e WHERE w = 'sign' AND bottom_m::DOUBLE >= 27 * 0.0254 - 1e-6)
    SELECT rule_id, outcome, count(*) AS n, min(id) AS first FROM (SELECT rule_id, id, CASE WHEN least AND v - 0.5 >= t - 1e-6 THEN 'passes' WHEN least AND v + 0.5 < t - 1e-6 THEN 'problem' WHEN NOT least AND v + 0.5 <= t + 1e-6 THEN 'passes'
    WHEN NOT least AND v - 0.5 > t + 1e-6 THEN 'problem' ELSE 'question' END AS outcome FROM m) GROUP BY ALL UNION ALL SELECT 'grab_bars', 'question', 1, NULL""")
def rule_outcomes(spark, sf_dir):
    """Rules over measured elements."""
    found = rules.evaluate(_elements(spark, sf_dir), rules.RULES, uncertainty=0.5)
    return found.groupBy("rule_id", "outcome").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("narrow_runs", """WITH r AS (SELECT l_orderkey AS route, l_linenumber * 40.0 + (l_partkey % 20) AS a, l_linenumber * 40.0 + (l_partkey % 20) + l_quantity AS b, 28 + l_suppkey % 10 AS w, l_partkey, l_suppkey FROM lineitem),
    s AS (SELECT *, lead(a) OVER (PARTITION BY route ORDER BY a, b) - b AS nxt FROM r) SELECT route, CASE WHEN bool_or(coalesce(w < 32 - 1e-6 OR b - a > 24 + 1e-6 OR nxt < 48 - 1e-6, false)) THEN 'problem' ELSE 'passes' END AS outcome FROM s GROUP BY route""")
def narrow_runs(spark, sf_dir):
    """A route that narrows in places."""
    start = F.col("l_linenumber") * 40.0 + F.col("l_partkey") % 20
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), start.alias("start"), (start + F.col("l_quantity")).alias("end"), (28 + F.col("l_suppkey") % 10).alias("width"))
    return rules.reduced_width(runs, ["route"])


@query("compliance_matrix", f"""SELECT w AS label, count(*) AS n FROM (SELECT list_extract({WORDS}, (p_partkey % 9 + 1)::INT) AS w FROM part) GROUP BY w""")
def compliance_matrix(spark, sf_dir):
    """Elements of each kind."""
    return _elements(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("arrangements", """SELECT p_brand, CASE WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'pair' WHEN rows = 1 THEN 'row' WHEN rows = 2 THEN 'two_rows' ELSE 'spread' END AS shape FROM (SELECT p_brand, count(*) AS n, max(g) + 1 AS rows FROM (
    SELECT p_brand, sum(new) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS g FROM (SELECT *, CASE WHEN p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) > 4 THEN 1 ELSE 0 END AS new FROM part)) GROUP BY p_brand)""")
def arrangements(spark, sf_dir):
    """W05, and part of Q05: the shape of a set of pieces from their chain groups."""
    groups = seq.chain_groups(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 4, ["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"), (F.max("group_id") + 1).alias("rows"))
    shape = F.when(F.col("n") == 1, "one").when(F.col("n") == 2, "pair").when(F.col("rows") == 1, "row").when(F.col("rows") == 2, "two_rows").otherwise("spread")
    return groups.select("p_brand", shape.alias("shape"))
