"""Queries of the operators over ordered rows, and of the scalar functions."""

from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import seq
from plumbline.registry import query
from plumbline.tables import table


@query("low_value_islands", """SELECT user_id, island, count(*) AS n, min(event_id) AS first_event, max(ts) AS last_ts FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
    FROM (SELECT *, value < 60 AS low, CASE WHEN value < 60 AND NOT coalesce(lag(value < 60) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 1 ELSE 0 END AS b FROM events))
    WHERE low GROUP BY user_id, island""")
def low_value_islands(spark, sf_dir):
    """W03."""
    runs = seq.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 60)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("ts").alias("last_ts"))


@query("running_value", """SELECT event_id, sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS so_far FROM events""")
def running_value(spark, sf_dir):
    """W04."""
    done = seq.running(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value").cast("decimal(18,2)"), "so_far")
    return done.select("event_id", F.col("so_far").cast("double").alias("so_far"))


@query("price_chains", """SELECT p_brand, group_id, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM (SELECT p_brand, p_retailprice, sum(new) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS group_id
    FROM (SELECT *, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 5 THEN 1 ELSE 0 END AS new FROM part)) GROUP BY ALL""")
def price_chains(spark, sf_dir):
    """W05."""
    groups = seq.chain_groups(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 5.0, ["p_partkey"])
    return groups.groupBy("p_brand", "group_id").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("chain_spacing", """WITH g AS (SELECT p_brand, group_id, avg(CAST(p_size AS DOUBLE)) AS centre FROM (SELECT p_brand, p_size, sum(new) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS group_id
    FROM (SELECT *, CASE WHEN p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) > 1 THEN 1 ELSE 0 END AS new FROM part)) GROUP BY ALL)
    SELECT p_brand, round(avg(d), 4) AS spacing FROM (SELECT p_brand, centre - lag(centre) OVER (PARTITION BY p_brand ORDER BY centre) AS d FROM g) GROUP BY p_brand""")
def chain_spacing(spark, sf_dir):
    """W06."""
    from pyspark.sql import Window as W

    groups = seq.chain_groups(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 1, ["p_partkey"])
    centres = groups.groupBy("p_brand", "group_id").agg(F.avg("p_size").alias("centre"))
    gap = F.col("centre") - F.lag("centre").over(W.partitionBy("p_brand").orderBy("centre"))
    return centres.withColumn("d", gap).groupBy("p_brand").agg(F.round(F.avg("d"), 4).alias("spacing"))


@query("event_transitions", """SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 4) AS share FROM (SELECT event_type AS from_state, nxt AS to_state, count(*) AS n
    FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL)""")
def event_transitions(spark, sf_dir):
    """W07."""
    return seq.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("until_first_purchase", """SELECT user_id, count(*) AS n FROM (SELECT user_id, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM events) WHERE done = 0 GROUP BY user_id""")
def until_first_purchase(spark, sf_dir):
    """W08."""
    return seq.until_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").groupBy("user_id").agg(F.count("*").alias("n"))


@query("stalled_events", """SELECT event_id, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS stalled,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS repeated FROM events""")
def stalled_events(spark, sf_dir):
    """W09, L15."""
    return seq.stalls(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "stalled", "repeated")


@query("after_last_purchase", """SELECT event_id FROM events e JOIN (SELECT user_id AS u, max(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) ON u = user_id WHERE ts >= m""")
def after_last_purchase(spark, sf_dir):
    """The last accepted row and everything after it."""
    e = table(spark, sf_dir, "events")
    last = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("m"))
    return e.join(last, "user_id").filter("ts >= m").select("event_id")


@query("every_third_event", """SELECT event_id FROM (SELECT event_id, row_number() OVER w - 1 AS i, lead(1) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i % 3 = 0 OR nxt IS NULL""")
def every_third_event(spark, sf_dir):
    """W11."""
    return seq.every_nth(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 3).select("event_id")


@query("spread_events", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    WHERE n <= 7 OR i IN (SELECT unnest([round_even(j * (n - 1) / 6, 0)::BIGINT for j in range(7)]))""")
def spread_events(spark, sf_dir):
    """W15."""
    return seq.evenly_spread(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 7).select("event_id")


@query("carried_value", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS origin FROM events""")
def carried_value(spark, sf_dir):
    """W18, J35."""
    e = table(spark, sf_dir, "events").withColumn("origin", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return seq.filled_forward(e, ["user_id"], ["ts", "event_id"], "origin").select("event_id", "origin")


@query("run_separations", """SELECT o_custkey, o_orderkey, epoch(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - o_orderdate)::BIGINT AS to_next FROM orders""")
def run_separations(spark, sf_dir):
    """W17, X06."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    from pyspark.sql import Window as W

    gap = F.lead("at").over(W.partitionBy("o_custkey").orderBy("at", "o_orderkey")) - F.col("at")
    return o.select("o_custkey", "o_orderkey", gap.cast("long").alias("to_next"))


@query("ranked_recall", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', -l_quantity, l_linenumber, l_partkey, l_suppkey) AS place
    FROM lineitem) WHERE place <= 2""")
def ranked_recall(spark, sf_dir):
    """W14."""
    from plumbline.operators import rel

    order = [F.col("l_returnflag") != "R", -F.col("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"]
    return rel.claim(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 2, order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query("interval_verdicts", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN low >= 40000 THEN 'satisfied' WHEN high < 40000 THEN 'violation' ELSE 'needs_verification' END AS verdict FROM (SELECT *,
    CASE WHEN l_returnflag <> 'A' THEN l_extendedprice * (1 - l_discount) END AS low, CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 + l_tax) END AS high FROM lineitem)""")
def interval_verdicts(spark, sf_dir):
    """A null bound is unknown and concludes nothing."""
    price = F.col("l_extendedprice")
    low = F.when(F.col("l_returnflag") != "A", price * (1 - F.col("l_discount")))
    high = F.when(F.col("l_linestatus") == "F", price * (1 + F.col("l_tax")))
    verdict = X.interval_verdict(low, high, F.lit(40000.0), "min")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict"))


@query("unit_verdicts", """SELECT p_partkey, m, CASE WHEN m IS NULL THEN 'needs_verification' WHEN m <= 0.9144 + 1e-6 THEN 'satisfied' ELSE 'violation' END AS verdict FROM (SELECT p_partkey,
    CASE p_partkey % 5 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 0.001::DOUBLE WHEN 2 THEN p_size * 0.01::DOUBLE WHEN 3 THEN p_size * 0.0254::DOUBLE END::DOUBLE AS m FROM part)""")
def unit_verdicts(spark, sf_dir):
    """Exact units; an unknown one needs verification."""
    k = F.col("p_partkey") % 5
    unit = F.when(k == 0, "m").when(k == 1, "mm").when(k == 2, "cm").when(k == 3, "in").otherwise("ft")
    m = X.in_metres(F.col("p_size").cast("double"), unit)
    verdict = F.when(F.col("m").isNull(), "needs_verification").when(X.meets(F.col("m"), "at_most", F.lit(0.9144)), "satisfied").otherwise("violation")
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).withColumn("verdict", verdict)


@query("sheet_predicates", """SELECT p_partkey, d[1] <= 0.05 AND d[2] > 0.05 AND (d[2] * d[3] >= 1.0 OR d[3] >= 2.0) AS is_sheet FROM (SELECT p_partkey,
    list_sort([p_size / 1000.0::DOUBLE, p_retailprice / 1000.0::DOUBLE, (p_partkey % 30) / 10.0::DOUBLE]) AS d FROM part)""")
def sheet_predicates(spark, sf_dir):
    """F04."""
    is_sheet = X.sheet(F.col("p_size") / 1000, F.col("p_retailprice") / 1000, (F.col("p_partkey") % 30) / 10)
    return table(spark, sf_dir, "part").select("p_partkey", is_sheet.alias("is_sheet"))


@query("floor_blockers", """SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1' AND p_size > 0 AND p_partkey % 11 <> 0 AND (p_size / 25.0 + p_partkey % 4) > 0.25 * 0.0254 AND p_partkey % 4 < 27 * 0.0254""")
def floor_blockers(spark, sf_dir):
    """F09."""
    bottom = (F.col("p_partkey") % 4).cast("double")
    p = table(spark, sf_dir, "part")
    return p.filter(X.blocks_floor(F.col("p_brand") == "Brand#1", F.col("p_size"), F.col("p_partkey") % 11 == 0, bottom, bottom + F.col("p_size") / 25)).select("p_partkey")


@query("word_search", """SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'thion') AND lang = 'en'""")
def word_search(spark, sf_dir):
    """F17."""
    return table(spark, sf_dir, "documents").filter(X.name_has_words(F.col("text"), "The thion") & (F.col("lang") == "en")).select("doc_id")


@query("normalised_names", """SELECT p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(translate(p_type, '-_', '  ')), '\\s+'), lambda x: x <> ''))).array_to_string(' ') AS words FROM part""")
def normalised_names(spark, sf_dir):
    """X01."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.normalised(F.col("p_type")), " ").alias("words"))


@query("event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def event_props(spark, sf_dir):
    """X10, X09."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").filter(k.isNotNull()).select("event_id", k.cast("long").alias("k"))


@query("template_text", """SELECT n_nationkey, 'Nation ' || n_name || ' lies in region ' || n_regionkey || CASE WHEN n_regionkey = 1 THEN ' (checked)' ELSE '' END AS text FROM nation""")
def template_text(spark, sf_dir):
    """Holes, and an optional part."""
    extra = F.when(F.col("n_regionkey") == 1, " (checked)").otherwise("")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Nation "), "n_name", F.lit(" lies in region "), F.col("n_regionkey").cast("string"), extra).alias("text"))


@query("feet_and_inches", """SELECT p_partkey, (p_size // 12) || ' ft ' || (p_size % 12) || CASE WHEN p_size % 12 = 1 THEN ' inch' ELSE ' inches' END AS words FROM part""")
def feet_and_inches(spark, sf_dir):
    """X03."""
    size = F.col("p_size")
    unit = F.when(size % 12 == 1, " inch").otherwise(" inches")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr("cast(p_size div 12 as string)"), F.lit(" ft "), (size % 12).cast("string"), unit).alias("words"))


@query("quantities_in_text", """SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?')) AS n, regexp_extract(text, '[0-9]+(\\.[0-9]+)?') AS first FROM documents WHERE regexp_matches(text, '[0-9]')""")
def quantities_in_text(spark, sf_dir):
    """Numbers alone."""
    number = F.lit(r"([0-9]+(\.[0-9]+)?)")
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]")).select(
        "doc_id", F.size(F.regexp_extract_all("text", number, F.lit(1))).cast("long").alias("n"), F.regexp_extract("text", r"([0-9]+(\.[0-9]+)?)", 1).alias("first")
    )


@query("vector_maths", """SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 5) AS norm, round(embedding[1]::DOUBLE * embedding[4]::DOUBLE - embedding[2]::DOUBLE * embedding[3]::DOUBLE, 6) AS cross_z,
    round(degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)), 4) AS heading FROM embeddings""")
def vector_maths(spark, sf_dir):
    """X07, X08."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    cross = F.col("e")[0] * F.col("e")[3] - F.col("e")[1] * F.col("e")[2]
    return e.select("vec_id", F.round(norm, 5).alias("norm"), F.round(cross, 6).alias("cross_z"), F.round(F.degrees(F.atan2(F.col("e")[1], F.col("e")[0])), 4).alias("heading"))


@query("three_way_compare", """SELECT p_partkey, CASE WHEN abs(p_retailprice / 1000 - p_size / 20.0) <= 0.01 THEN 0 WHEN p_retailprice / 1000 < p_size / 20.0 THEN -1 ELSE 1 END AS cmp FROM part""")
def three_way_compare(spark, sf_dir):
    """X15, X16."""
    return table(spark, sf_dir, "part").select("p_partkey", X.three_way(F.col("p_retailprice") / 1000, F.col("p_size") / 20.0).alias("cmp"))


@query("half_even_rounding", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 8, 2) AS price FROM lineitem""")
def half_even_rounding(spark, sf_dir):
    """X13."""
    price = F.bround(F.col("l_quantity") / 8, 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("price"))
