"""Further queries: filters, tallies, topics, markings, corridors, and rule templates over measured elements."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import kernels, seq
from plumbline.registry import query
from plumbline.tables import table


@query("translations", "SELECT n_nationkey, n_nationkey * 1.5::DOUBLE AS x, n_regionkey * 2.0::DOUBLE AS y, 0.5::DOUBLE AS z FROM nation")
def translations(spark, sf_dir):
    """the translation of a row-major 4 x 4 matrix."""
    cell = {3: F.col("n_nationkey") * 1.5, 7: F.col("n_regionkey") * 2.0, 11: F.lit(0.5)}
    matrix = F.array(*[cell.get(i, F.lit(1.0 if i % 5 == 0 else 0.0)) for i in range(16)])
    return table(spark, sf_dir, "nation").select("n_nationkey", X.position(matrix).alias("p")).select("n_nationkey", "p.*")


@query("optional_filters", """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND (NULL IS NULL OR o_custkey = NULL) AND coalesce(o_totalprice, 0) > 100000""")
def optional_filters(spark, sf_dir):
    """an optional parameter that isn't given filters nothing."""
    wanted = None
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P") & (F.coalesce("o_totalprice", F.lit(0.0)) > 100000))
    return (o if wanted is None else o.filter(F.col("o_custkey") == wanted)).select("o_orderkey")


@query("sum_with_zero", "SELECT c_custkey, coalesce(sum(CAST(value AS DECIMAL(18, 2))), 0)::DOUBLE AS total FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'purchase' GROUP BY c_custkey")
def sum_with_zero(spark, sf_dir):
    """G02, J02."""
    sums = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("s"))
    return table(spark, sf_dir, "customer").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(0)).cast("double").alias("total"))


@query("surface_tally", """SELECT p_brand, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS seen, sum(p_size) FILTER (WHERE p_partkey % 3 <> 0) AS seen_area, sum(p_size) FILTER (WHERE p_partkey % 3 = 0) AS never_seen,
    round(count(*) FILTER (WHERE p_partkey % 3 <> 0) * sum(p_size) / sum(p_size) FILTER (WHERE p_partkey % 3 <> 0), 4) AS estimate FROM part GROUP BY p_brand""")
def surface_tally(spark, sf_dir):
    """Counts over seen patches, scaled to the whole area."""
    seen = F.col("p_partkey") % 3 != 0
    by = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(seen).alias("seen"), F.sum(F.when(seen, F.col("p_size"))).alias("seen_area"), F.sum(F.when(~seen, F.col("p_size"))).alias("never_seen"), F.sum("p_size").alias("area"))
    return by.select("p_brand", "seen", "seen_area", "never_seen", F.round(F.try_divide(F.col("seen") * F.col("area"), F.col("seen_area")), 4).alias("estimate"))


@query("permuted_sample", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT (i * 7 + 3) % 25 FROM range(10) t(i))")
def permuted_sample(spark, sf_dir):
    """A sample without replacement is the feature."""
    return table(spark, sf_dir, "nation").filter(F.col("n_nationkey").isin(seq.sample_without_replacement(25, 10, 7, 3))).select("n_nationkey")


@query("question_topics", """SELECT conv_id, turn, topic FROM conversations, (VALUES ('the', 'route_clear_width'), ('door', 'door_clear_width'), ('ing', 'reach_range')) t(word, topic) WHERE contains(lower(text), word)""")
def question_topics(spark, sf_dir):
    """Words of a question to checks; the list is fixed."""
    topics = {"the": "route_clear_width", "door": "door_clear_width", "ing": "reach_range"}
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(t)) for w, t in topics.items()]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("topic"))


@query("markings", """SELECT p_partkey, CASE WHEN min(least(p_size / 50.0, 1)) >= 0.6 THEN 'measured' ELSE 'low' END AS quality, count(*) AS n FROM part GROUP BY p_partkey""")
def markings(spark, sf_dir):
    """A piece's confidence, trusted from 0.6."""
    by = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.min(F.least(F.col("p_size") / 50.0, F.lit(1.0))).alias("c"), F.count("*").alias("n"))
    return by.select("p_partkey", F.when(F.col("c") >= 0.6, "measured").otherwise("low").alias("quality"), "n")


@query("free_corridors", """SELECT p_brand, round(2 * min(abs((p_retailprice - 900) / 200 - 5) - p_size / 100.0), 6) AS corridor FROM part GROUP BY p_brand""")
def free_corridors(spark, sf_dir):
    """Twice the least gap of obstacles to a straight line."""
    band = table(spark, sf_dir, "part")
    gap = F.abs((F.col("p_retailprice") - 900) / 200 - 5) - F.col("p_size") / 100.0
    return band.groupBy("p_brand").agg(F.round(2 * F.min(gap), 6).alias("corridor"))


@query("positions_in_words", """SELECT p_partkey, CASE WHEN p_size < 17 THEN 'left' WHEN p_size > 34 THEN 'right' ELSE 'middle' END || ' ' || CASE WHEN p_partkey % 80 < 27 THEN 'front' WHEN p_partkey % 80 > 53 THEN 'back' ELSE 'middle' END AS words FROM part""")
def positions_in_words(spark, sf_dir):
    """Words for thirds of an axis."""
    third = lambda v, a, b, low, high: F.when(v < a, low).when(v > b, high).otherwise("middle")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", third(F.col("p_size"), 17, 34, "left", "right"), third(F.col("p_partkey") % 80, 27, 53, "front", "back")).alias("words"))


@query("answer_names_known", """SELECT doc_id, count(*) FILTER (WHERE w NOT IN ('the', 'of', 'and', 'to', 'in')) AS n_unknown, count(*) FILTER (WHERE w NOT IN ('the', 'of', 'and', 'to', 'in')) = 0 AS grounded
    FROM (SELECT doc_id, unnest(list_concat(['the'], list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> ''))) AS w FROM documents) GROUP BY doc_id""")
def answer_names_known(spark, sf_dir):
    """Q10: words of a whole text that aren't among the known names."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0b\\x0c\\r]+"), lambda w: w != "")
    unknown = F.size(F.filter(words, lambda w: ~w.isin("the", "of", "and", "to", "in")))
    return table(spark, sf_dir, "documents").select("doc_id", unknown.cast("long").alias("n_unknown"), (unknown == 0).alias("grounded"))


@query("turn_widths", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 60 - 1e-6 OR l_tax * 1000 >= 48 - 1e-6 THEN 'exempt' WHEN l_quantity >= 42 - 1e-6 AND l_discount * 1000 >= 36 - 1e-6 THEN 'passes' ELSE 'problem' END AS outcome FROM lineitem""")
def turn_widths(spark, sf_dir):
    """Widths before, at and after a turn, each against its own parameter; wide elements are exempt."""
    at, near, element = F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_tax") * 1000
    wide = X.meets(at, "at_least", F.lit(60.0)) | X.meets(element, "at_least", F.lit(48.0))
    good = X.meets(at, "at_least", F.lit(42.0)) & X.meets(near, "at_least", F.lit(36.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(wide, "exempt").when(good, "passes").otherwise("problem").alias("outcome"))


@query("passing_spaces", """WITH s AS (SELECT l_orderkey, l_shipdate, l_quantity >= 40 AS space, l_linenumber, l_partkey, l_suppkey FROM lineitem), g AS (SELECT l_orderkey, max(d) AS worst FROM (SELECT l_orderkey, epoch_us(l_shipdate) // 1000000 - lag(epoch_us(l_shipdate) // 1000000) OVER
    (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS d FROM s WHERE space) GROUP BY 1) SELECT l_orderkey, coalesce(worst, 0) <= 200 * 86400 AS complies FROM g""")
def passing_spaces(spark, sf_dir):
    """Wide places along a route lie no farther apart than the interval."""
    from pyspark.sql import Window as W

    s = table(spark, sf_dir, "lineitem").filter("l_quantity >= 40").withColumn("at", F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    gap = F.col("at") - F.lag("at").over(W.partitionBy("l_orderkey").orderBy("at", "l_linenumber", "l_partkey", "l_suppkey"))
    return s.withColumn("d", gap).groupBy("l_orderkey").agg((F.coalesce(F.max("d"), F.lit(0)) <= 200 * 86400).alias("complies"))


@query("exit_legs", """SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS to_exit, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'held' END AS rest FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0""")
def exit_legs(spark, sf_dir):
    """Legs that reach an exit, with a held row for the rest of the section; nothing without an exit."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("to_exit"))
    return by.filter("to_exit > 0").withColumn("rest", F.lit("held"))


@query("door_clearances", """SELECT p_partkey, CASE WHEN p_size >= 30 THEN 'passes' WHEN p_size >= 18 THEN 'question' ELSE 'problem' END AS outcome FROM part""")
def door_clearances(spark, sf_dir):
    """Deep enough to pull, either way passes; only to push, it depends on the swing."""
    size = F.col("p_size").cast("double")
    deep = X.meets(size, "at_least", F.lit(30.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(deep, "passes").when(X.meets(size, "at_least", F.lit(18.0)), "question").otherwise("problem").alias("outcome"))


@query("banded_heights", """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'question' WHEN p_size BETWEEN 17 - 1e-6 AND 34 + 1e-6 THEN 'passes' ELSE 'problem' END AS outcome FROM part""")
def banded_heights(spark, sf_dir):
    """A value between two limits; without a partner to measure from it is a question."""
    size = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size").cast("double"))
    inside = X.meets(size, "at_least", F.lit(17.0)) & X.meets(size, "at_most", F.lit(34.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(size.isNull(), "question").when(inside, "passes").otherwise("problem").alias("outcome"))


@query("ramp_slopes", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(p_size * 1.0::DOUBLE / (p_partkey % 5), 4) END AS run_per_rise, CASE WHEN p_partkey % 5 = 0 OR p_size * 1.0 / (p_partkey % 5) >= 12 - 1e-6 THEN 'passes' ELSE 'problem' END AS outcome FROM part""")
def ramp_slopes(spark, sf_dir):
    """Run over rise of a ramp; a flat one has none and passes."""
    ratio = F.try_divide(F.col("p_size").cast("double"), F.col("p_partkey") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ratio, 4).alias("run_per_rise"), F.when(ratio.isNull() | X.meets(ratio, "at_least", F.lit(12.0)), "passes").otherwise("problem").alias("outcome"))


@query("kiosk_faces", """SELECT p_partkey, CASE WHEN greatest(a, b) >= 48 - 1e-6 AND least(a, b) >= 30 - 1e-6 THEN 'either' WHEN greatest(a, b) >= 30 - 1e-6 THEN 'one' ELSE 'none' END AS fits FROM (SELECT p_partkey, p_size * 1.0 AS a, p_partkey % 60 * 1.0 AS b FROM part)""")
def kiosk_faces(spark, sf_dir):
    """A clear floor of 48 by 30 inches in either orientation."""
    a, b = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double")
    long, short = F.greatest(a, b), F.least(a, b)
    both = X.meets(long, "at_least", F.lit(48.0)) & X.meets(short, "at_least", F.lit(30.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(both, "either").when(X.meets(long, "at_least", F.lit(30.0)), "one").otherwise("none").alias("fits"))


@query("seen_floor")
def seen_floor(spark, sf_dir):
    """Cells of a floor that points were seen over, their regions, and a fixed ray's hit of a fixed box."""

    def kernel(pdf):
        x = pdf[["x", "y"]].to_numpy(float)
        cells = np.floor((x + 1) / 0.25).astype(int)
        seen = np.zeros((9, 9), bool)
        inside = ((cells >= 0) & (cells < 9)).all(1)
        seen[cells[inside, 1], cells[inside, 0]] = True
        label = kernels.labels(seen)
        hit = kernels.ray_box(np.zeros(3), np.array([1.0, 0.2, 0.1]), np.array([1.0, -1, -1]), np.array([2.0, 1, 1]))
        return {"seen": int(seen.sum()), "regions": int(label.max()), "hit": hit}

    e = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xy")])
    return kernels.per_room(e, "label", kernel, "seen int, regions int, hit double")
