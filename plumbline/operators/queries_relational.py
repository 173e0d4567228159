"""Queries of the relational and aggregate operators."""

from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import evaluation, rel, seq
from plumbline.registry import query
from plumbline.tables import table

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("latest_order_per_customer", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_order_per_customer(spark, sf_dir):
    """W01."""
    orders = table(spark, sf_dir, "orders")
    return rel.latest_by(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("latest_shipment_by_max", """SELECT l_suppkey, max(l_shipdate) AS last_ship, count(*) AS n_on_last FROM lineitem JOIN
    (SELECT l_suppkey AS s, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_suppkey = s AND l_shipdate = m GROUP BY l_suppkey""")
def latest_shipment_by_max(spark, sf_dir):
    """Rows on the group's latest date, in one pass and without a join back."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("n"))
    last = counted.groupBy("l_suppkey").agg(F.max(F.struct("l_shipdate", "n")).alias("x"))
    return last.select("l_suppkey", F.col("x.l_shipdate").alias("last_ship"), F.col("x.n").alias("n_on_last"))


@query("customer_order_totals", """SELECT n_name, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def customer_order_totals(spark, sf_dir):
    """Inner joins with a sum; the small dimension is left to the planner."""
    return (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    )


@query("purchases_left_join", """SELECT c_custkey, count(event_id) AS n_purchases FROM customer LEFT JOIN events
    ON user_id = c_custkey AND event_type = 'purchase' GROUP BY c_custkey""")
def purchases_left_join(spark, sf_dir):
    """A left join on a key and a constant."""
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("event_id").alias("n"))
    return (
        table(spark, sf_dir, "customer").join(events, F.col("user_id") == F.col("c_custkey"), "left")
        .select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_purchases"))
    )


@query("customers_without_urgent", """SELECT c_custkey FROM customer WHERE NOT EXISTS
    (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def customers_without_urgent(spark, sf_dir):
    """J06."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.without(table(spark, sf_dir, "customer"), urgent, ["c_custkey"]).select("c_custkey")


@query("customers_with_urgent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_with_urgent(spark, sf_dir):
    """J07."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("orders_above_customer_mean", """SELECT o_orderkey FROM orders o WHERE o_totalprice >
    (SELECT 2 * min(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def orders_above_customer_mean(spark, sf_dir):
    """A correlated scalar subquery as one aggregate and a join."""
    orders = table(spark, sf_dir, "orders")
    least = orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"))
    return orders.join(least, "o_custkey").filter("o_totalprice > 2 * least").select("o_orderkey")


@query("coverage_manifest", """SELECT coalesce(n_nationkey, s, c) AS nation, n_nationkey IS NOT NULL AS has_nation, s IS NOT NULL AS has_supplier,
    c IS NOT NULL AS has_customer FROM nation FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier WHERE s_acctbal > 5000) ON s = n_nationkey
    FULL JOIN (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_acctbal > 9000) ON c = coalesce(n_nationkey, s)""")
def coverage_manifest(spark, sf_dir):
    """J10, S20."""
    return rel.reconcile(
        {
            "nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")),
            "supplier": table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")),
            "customer": table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")),
        },
        "nation",
    )


TREE = """SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"""


def _tree(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"))
        .union(table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .union(table(spark, sf_dir, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))
    )


@query("tree_children", f"WITH t AS ({TREE}) SELECT parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY parent")
def tree_children(spark, sf_dir):
    """J11."""
    return _tree(spark, sf_dir).filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))


@query("tree_descendants", f"""WITH RECURSIVE t AS ({TREE}), d AS (SELECT node AS root, node, 0 AS depth FROM t WHERE parent IS NULL
    UNION ALL SELECT root, t.node, depth + 1 FROM d JOIN t ON t.parent = d.node) SELECT root, node, depth FROM d""")
def tree_descendants(spark, sf_dir):
    """J12, J13."""
    tree = _tree(spark, sf_dir)
    return rel.descendants(tree.filter("parent is not null"), tree.filter("parent is null").select(F.col("child").alias("root")))


@query("tree_unresolved", f"WITH t AS ({TREE}) SELECT node AS child, parent FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM t WHERE node <> 'n3')")
def tree_unresolved(spark, sf_dir):
    """Dangling parents, after one node was taken away."""
    tree = _tree(spark, sf_dir)
    return rel.unresolved(tree.filter("parent is not null"), tree.filter("child <> 'n3'").select(F.col("child").alias("node"))).select("child", "parent")


@query("lineitem_changes", """WITH b AS (SELECT l_partkey, round(max(l_quantity)) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1994-01-01' GROUP BY 1),
    a AS (SELECT l_partkey, round(max(l_quantity)) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1)
    SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN b.q IS NULL THEN 'added' WHEN a.q IS NULL THEN 'removed' ELSE 'changed' END AS kind
    FROM b FULL JOIN a ON a.l_partkey = b.l_partkey WHERE a.q IS DISTINCT FROM b.q""")
def lineitem_changes(spark, sf_dir):
    """J24."""
    lines = table(spark, sf_dir, "lineitem")
    state = lambda df: df.groupBy("l_partkey").agg(F.round(F.max("l_quantity")).alias("q"))
    return rel.changes(state(lines.filter("l_shipdate < timestamp '1994-01-01'")), state(lines.filter("l_shipdate >= timestamp '1998-06-01'")), "l_partkey", "q")


@query("lost_matches", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b
    WHERE b.l_returnflag = 'A' AND b.l_partkey = a.l_partkey AND abs(b.l_quantity - a.l_quantity) <= 2)""")
def lost_matches(spark, sf_dir):
    """An anti-join with a key and a tolerance."""
    lines = table(spark, sf_dir, "lineitem")
    kept = lines.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    lost = lines.filter("l_returnflag = 'R'")
    return lost.join(kept, (lost.l_partkey == kept.p) & (F.abs(lost.l_quantity - kept.q) <= 2), "left_anti").select(*LINE)


@query("leak_free_split", """WITH held AS (SELECT DISTINCT source FROM documents WHERE doc_id % 50 = 0) SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'held_out'
    WHEN source IN (SELECT source FROM held) THEN 'dropped' ELSE 'train' END AS split FROM documents""")
def leak_free_split(spark, sf_dir):
    """What shares a piece with held-out rows is dropped from training."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("pieces"))
    return evaluation.leak_free_split(rows, "doc_id", "pieces", F.col("doc_id") % 50 == 0)


@query("split_counts", """SELECT lang, doc_id % 3 AS part, count(*) AS n, grouping(lang) + grouping(doc_id % 3) AS level FROM documents GROUP BY ROLLUP (lang, doc_id % 3)""")
def split_counts(spark, sf_dir):
    """G10."""
    d = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 3).alias("part"))
    return d.rollup("lang", "part").agg(F.count("*").alias("n"), (F.grouping("lang") + F.grouping("part")).cast("long").alias("level"))


@query("users_with_all_types", """SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase')
    GROUP BY user_id HAVING count(DISTINCT event_type) = 3""")
def users_with_all_types(spark, sf_dir):
    """Relational division."""
    return rel.having_all(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase"])


@query("event_funnel", """SELECT count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewed,
    count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicked, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS bought
    FROM events""")
def event_funnel(spark, sf_dir):
    """One row a user first, so that no distinct set grows."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(
        *[F.max((F.col("event_type") == t).cast("int")).alias(t) for t in ("view", "click", "purchase")]
    )
    return by.agg(F.count("*").alias("users"), F.sum("view").alias("viewed"), F.sum("click").alias("clicked"), F.sum("purchase").alias("bought"))


@query("median_first_purchase", """SELECT median(epoch(first_buy) - epoch(first_seen)) / 60 AS minutes FROM (SELECT user_id, min(ts) AS first_seen,
    min(ts) FILTER (WHERE event_type = 'purchase') AS first_buy FROM events GROUP BY user_id)""")
def median_first_purchase(spark, sf_dir):
    """G07, G08."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("b"))
    seconds = F.unix_micros(F.col("b").cast("timestamp")) / 1e6 - F.unix_micros(F.col("a").cast("timestamp")) / 1e6
    exact = seq.percentiles(by.select(F.lit(0).alias("all"), seconds.alias("s")).filter("s is not null"), "all", "s", [0.5])
    return exact.select((F.col("q")[0] / 60).alias("minutes"))


@query("most_severe_line", """SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity <= 25, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def most_severe_line(spark, sf_dir):
    """G22, O01."""
    return rel.most_severe(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], F.col("l_quantity") <= 25, F.col("l_extendedprice"), ["l_linenumber", "l_partkey", "l_suppkey"]
    ).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")


@query("worst_verdict", """SELECT l_suppkey, min_by(outcome, rank) AS worst FROM (SELECT l_suppkey, CASE WHEN l_quantity > 45 THEN 'problem' WHEN l_discount > 0.08
    THEN 'question' ELSE 'passes' END AS outcome, CASE WHEN l_quantity > 45 THEN 0 WHEN l_discount > 0.08 THEN 1 ELSE 2 END AS rank FROM lineitem) GROUP BY l_suppkey""")
def worst_verdict(spark, sf_dir):
    """G21."""
    rank = F.when(F.col("l_quantity") > 45, 0).when(F.col("l_discount") > 0.08, 1).otherwise(2)
    worst = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(rank).alias("r"))
    return worst.select("l_suppkey", F.when(F.col("r") == 0, "problem").when(F.col("r") == 1, "question").otherwise("passes").alias("worst"))


@query("order_shortfall", """SELECT l_orderkey, sum(greatest(0, 30 - CAST(l_quantity AS DECIMAL(10, 2))))::DOUBLE AS shortfall, max_by(l_partkey, (l_quantity, -l_partkey)) AS largest
    FROM lineitem GROUP BY l_orderkey""")
def order_shortfall(spark, sf_dir):
    """G23, G24."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.greatest(F.lit(0).cast("decimal(10,2)"), F.lit(30) - F.col("l_quantity").cast("decimal(10,2)"))).cast("double").alias("shortfall"),
        F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_partkey"))).alias("largest"),
    )


@query("first_matching_event", """SELECT user_id, event_id FROM events WHERE value > 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def first_matching_event(spark, sf_dir):
    """G25."""
    high = table(spark, sf_dir, "events").filter("value > 100")
    return high.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("weighted_vote", """SELECT user_id, event_type, support, round(support / total, 4) AS share FROM (SELECT user_id, event_type, support, sum(support) OVER (PARTITION BY user_id) AS total,
    row_number() OVER (PARTITION BY user_id ORDER BY support DESC, event_type) AS rn FROM (SELECT user_id, event_type, sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS support
    FROM events GROUP BY ALL)) WHERE rn = 1""")
def weighted_vote(spark, sf_dir):
    """The name with the most weight, and its share."""
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("support"))
    top = by.groupBy("user_id").agg(F.sum("support").alias("total"), F.min_by(F.struct("event_type", "support"), F.struct(-F.col("support"), "event_type")).alias("x"))
    return top.select("user_id", "x.event_type", "x.support", F.round(F.col("x.support") / F.col("total"), 4).alias("share"))


@query("quantity_mode", """SELECT bin, n, round(n / total, 4) AS share FROM (SELECT floor((l_quantity - 1) / 5)::BIGINT AS bin, count(*) AS n, sum(count(*)) OVER () AS total
    FROM lineitem GROUP BY bin) QUALIFY row_number() OVER (ORDER BY n DESC, bin) = 1""")
def quantity_mode(spark, sf_dir):
    """The fullest histogram bin and its share."""
    bins = table(spark, sf_dir, "lineitem").groupBy(F.floor((F.col("l_quantity") - 1) / 5).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.agg(F.sum("n").alias("total"), F.min_by(F.struct("bin", "n"), F.struct(-F.col("n"), "bin")).alias("x"))
    return top.select("x.bin", "x.n", F.round(F.col("x.n") / F.col("total"), 4).alias("share"))


@query("trimmed_bounds", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 3) AS low, round(median(l_extendedprice), 3) AS mid, round(quantile_cont(l_extendedprice, 0.98), 3) AS high,
    min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag""")
def trimmed_bounds(spark, sf_dir):
    """G03, G29, G30."""
    lines = table(spark, sf_dir, "lineitem")
    by = lines.groupBy("l_returnflag").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    exact = seq.percentiles(lines, "l_returnflag", "l_extendedprice", [0.02, 0.5, 0.98])
    return by.join(exact, "l_returnflag").select("l_returnflag", *[F.round(F.col("q")[i], 3).alias(n) for i, n in enumerate(("low", "mid", "high"))], "least", "most")


@query("order_fingerprint", """SELECT l_orderkey, sha256(string_agg(row, chr(10) ORDER BY row)) AS fingerprint FROM (SELECT l_orderkey,
    concat_ws('|', l_linenumber, l_partkey, l_suppkey, printf('%.6f', l_quantity)) AS row FROM lineitem) GROUP BY l_orderkey""")
def order_fingerprint(spark, sf_dir):
    """G31, X11, X13."""
    row = F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey", F.format_string("%.6f", "l_quantity"))
    return rel.fingerprint(table(spark, sf_dir, "lineitem"), ["l_orderkey"], row)


@query("missing_kinds", """SELECT o_custkey, list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: NOT list_contains(list(DISTINCT o_orderpriority), x)))
    .array_to_string(',') AS missing FROM orders GROUP BY o_custkey""")
def missing_kinds(spark, sf_dir):
    """G32."""
    wanted = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_except(wanted, F.collect_set("o_orderpriority"))), ",").alias("missing"))


@query("interval_sums", """SELECT l_orderkey, CASE WHEN count(low) = count(*) THEN sum(low)::DOUBLE END AS low, CASE WHEN count(high) = count(*) THEN sum(high)::DOUBLE END AS high FROM (SELECT l_orderkey,
    CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS DECIMAL(10, 2)) - 1 END AS low, CAST(l_quantity AS DECIMAL(10, 2)) + 1 AS high FROM lineitem) GROUP BY l_orderkey""")
def interval_sums(spark, sf_dir):
    """G33."""
    q = F.col("l_quantity").cast("decimal(10,2)")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", q - 1).alias("low"), (q + 1).alias("high"))
    low, high = X.interval_sum("low", "high")
    return rows.groupBy("l_orderkey").agg(low, high).select("l_orderkey", F.col("low").cast("double"), F.col("high").cast("double"))


@query("required_counts", """SELECT l_orderkey, count(*) AS n, greatest(1, ceil(count(*) * 0.05))::INT AS needed, count(*) FILTER (WHERE l_quantity >= 28 AND l_quantity <= 34) AS complying FROM lineitem GROUP BY 1""")
def required_counts(spark, sf_dir):
    """G34, C12."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity").between(28, 34)).alias("complying"))
    return by.select("l_orderkey", "n", X.required_count(F.col("n"), F.lit(0.05)).alias("needed"), "complying")


@query("label_precision_recall", """SELECT source, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM (
    SELECT source, count(*) FILTER (WHERE quality = 1 AND n_chars > 1000) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars > 1000) AS fp,
    count(*) FILTER (WHERE quality = 1 AND n_chars <= 1000) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def label_precision_recall(spark, sf_dir):
    """A length rule as a classifier of quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return evaluation.precision_recall(rows, ["source"], F.col("n_chars") > 1000, F.col("quality") == 1)


@query("wilson_bounds", """SELECT source, k, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) AS low,
    round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) AS high FROM (SELECT source, count(*) AS n,
    count(*) FILTER (WHERE toxic = 1) AS k, count(*) FILTER (WHERE toxic = 1) / count(*) AS p, 1.96 AS z FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def wilson_bounds(spark, sf_dir):
    """G17."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    by = rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return by.select("source", "k", "n", low.alias("low"), high.alias("high"))


@query("arm_metrics", """SELECT l_shipdate < TIMESTAMP '1995-01-01' AS arm, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 4) AS accepted, round(avg(CASE WHEN l_returnflag = 'R'
    THEN l_discount END), 4) AS reward_if_accepted, count(*) FILTER (WHERE l_discount IS NULL) AS missing FROM lineitem GROUP BY 1""")
def arm_metrics(spark, sf_dir):
    """Conditional rates and means of each arm in one pass."""
    accepted = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_shipdate") < F.expr("timestamp '1995-01-01'")).alias("arm")).agg(
        F.count("*").alias("n"), F.round(F.avg(accepted.cast("int")), 4).alias("accepted"),
        F.round(F.avg(F.when(accepted, F.col("l_discount"))), 4).alias("reward_if_accepted"), F.count_if(F.col("l_discount").isNull()).alias("missing"),
    )


@query("best_and_all_of", """SELECT k, round(avg(best::INT), 4) AS best_of, round(avg(every::INT), 4) AS all_of FROM (SELECT o_custkey % 4 AS k, o_custkey, bool_or(o_orderstatus = 'F') AS best,
    bool_and(o_orderstatus = 'F') AS every FROM orders GROUP BY ALL) GROUP BY k""")
def best_and_all_of(spark, sf_dir):
    """G15, G16."""
    return evaluation.best_and_all(table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 4), "k", "o_custkey", F.col("o_orderstatus") == "F")


@query("cross_tab", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def cross_tab(spark, sf_dir):
    """G11, G35."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return counted.na.fill(0)


@query("nearest_measurement_error", """SELECT o_custkey, round(avg(coalesce(err, 120)), 4) AS error FROM (SELECT o_custkey, o_orderkey, min(abs(l_quantity - 25)) AS err
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey""")
def nearest_measurement_error(spark, sf_dir):
    """The nearest measurement to what is expected, 120 where there is none."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.abs(F.col("l_quantity") - 25)).alias("err"))
    return table(spark, sf_dir, "orders").join(found, "o_orderkey", "left").groupBy("o_custkey").agg(F.round(F.avg(F.coalesce("err", F.lit(120.0))), 4).alias("error"))


@query("scored_means", """SELECT scorer, round(avg(score), 6) AS mean, count(score) AS n FROM (SELECT unnest(['quality', 'clean']) AS scorer, unnest([quality::DOUBLE, CASE WHEN quality = 1 THEN 1 - toxic END]) AS score
    FROM labels) WHERE score IS NOT NULL GROUP BY scorer""")
def scored_means(spark, sf_dir):
    """Long form of scores; nulls are skipped, and a scorer without values is omitted."""
    quality, toxic = F.col("quality").cast("double"), F.col("toxic")
    rows = table(spark, sf_dir, "labels").select(F.explode(F.create_map(F.lit("quality"), quality, F.lit("clean"), F.when(quality == 1, (1 - toxic).cast("double")))).alias("scorer", "score"))
    return rows.filter("score is not null").groupBy("scorer").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))


@query("gate_reasons", """SELECT l_orderkey, after_n < before_n AS fewer, CASE WHEN after_n < before_n AND worst <= 0.1 THEN true WHEN worst IS NULL THEN NULL ELSE false END AS accepted FROM (SELECT l_orderkey,
    count(*) FILTER (WHERE l_returnflag = 'R') AS before_n, count(*) FILTER (WHERE l_returnflag = 'A') AS after_n, max(CASE WHEN l_returnflag <> 'N' THEN l_discount END) AS worst FROM lineitem GROUP BY 1)""")
def gate_reasons(spark, sf_dir):
    """A gate whose unknown measurements leave it unknown."""
    flag = F.col("l_returnflag")
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(flag == "R").alias("b"), F.count_if(flag == "A").alias("a"), F.max(F.when(flag != "N", F.col("l_discount"))).alias("worst")
    )
    return by.select("l_orderkey", (F.col("a") < F.col("b")).alias("fewer"), evaluation.gate(F.col("a") < F.col("b"), F.col("worst") <= 0.1, F.col("worst")).alias("accepted"))


@query("claim_order", """SELECT o_orderpriority, o_orderkey, place FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place
    FROM orders WHERE o_orderstatus = 'O') WHERE place <= 3""")
def claim_order(spark, sf_dir):
    """What each lane claims next."""
    queued = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return rel.claim(queued, ["o_orderpriority"], 3, [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderpriority", "o_orderkey", "place")


@query("pick_extremes", """SELECT p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_min(p_partkey, (abs(p_size - 20), p_size, p_partkey)) AS closest
    FROM part GROUP BY p_brand""")
def pick_extremes(spark, sf_dir):
    """First on ties."""
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min_by("p_partkey", F.struct(-price, key)).alias("dearest"), F.min_by("p_partkey", F.struct(price, key)).alias("cheapest"),
        F.min_by("p_partkey", F.struct(F.abs(size - 20), size, key)).alias("closest"),
    )


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf_dir):
    """A top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("set_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_union(spark, sf_dir):
    """U02."""
    a, b = _sides(spark, sf_dir)
    return a.union(b).distinct()


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference(spark, sf_dir):
    """U01, U03."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("set_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersection(spark, sf_dir):
    """U03."""
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query("set_symmetric_difference", """(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier) UNION
    (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)""")
def set_symmetric_difference(spark, sf_dir):
    """Keys that are on one side only."""
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


def _sides(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return a, table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@query("documents_without_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_labels(spark, sf_dir):
    """J06, F28."""
    return rel.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("label_counts", """SELECT lang, source, count(*) AS n, string_agg(DISTINCT doc_id % 5, ',' ORDER BY doc_id % 5) AS kinds FROM documents GROUP BY ALL""")
def label_counts(spark, sf_dir):
    """G01, G05, G09."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("doc_id") % 5)).cast("array<string>"), ",").alias("kinds")
    )


@query("upsert_orders", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus <> 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus <> 'P' THEN 2 ELSE 1 END AS version FROM orders UNION ALL SELECT -1, 5.0, 1""")
def upsert_orders(spark, sf_dir):
    """Replaces unlocked rows, adds new ones, raises versions."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("version"), "o_orderstatus")
    new = old.filter("o_orderkey % 10 = 0").withColumn("price", F.col("price") + 1)
    extra = spark.createDataFrame([(-1, 5.0, 1, "O")], "o_orderkey long, price double, version int, o_orderstatus string")
    return rel.upsert(old, new.union(extra), ["o_orderkey"], guard=F.col("o_orderstatus") != "P").drop("o_orderstatus")


@query("enqueue_ignore", "SELECT c_custkey AS job, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 ELSE 9 END AS kind FROM customer")
def enqueue_ignore(spark, sf_dir):
    """T02, T06, D02, D03."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 7).alias("kind"))
    return rel.insert_or_ignore(old, c.select(F.col("c_custkey").alias("job"), F.lit(9).cast("long").alias("kind")), ["job"])


@query("cascade_delete", "SELECT count(*) AS n_orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS n_lines FROM orders WHERE o_orderstatus <> 'P'")
def cascade_delete(spark, sf_dir):
    """D04."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    gone = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    left = rel.cascade_delete({"o": orders.withColumn("k", F.col("o_orderkey")), "l": lines.withColumn("k", F.col("l_orderkey"))}, "k", gone)
    both = left["o"].select(F.lit("o").alias("t")).union(left["l"].select(F.lit("l")))
    return both.agg(F.count_if(F.col("t") == "o").alias("n_orders"), F.count_if(F.col("t") == "l").alias("n_lines"))


@query("stale_results", """SELECT o_orderkey FROM orders JOIN (SELECT o_custkey AS c, max(o_orderdate) AS m FROM orders GROUP BY 1) ON c = o_custkey WHERE o_orderdate < m - INTERVAL 30 DAY AND o_orderstatus IS DISTINCT FROM 'F'""")
def stale_results(spark, sf_dir):
    """Older than a period before the newest, and not yet recomputed."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return orders.join(newest, "o_custkey").filter("o_orderdate < m - interval 30 days and not (o_orderstatus <=> 'F')").select("o_orderkey")


@query("attempt_limits", """SELECT user_id, count(*) AS attempts, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 3 THEN 'failed' ELSE 'queued' END AS state,
    least(60 * pow(2, greatest(count(*) FILTER (WHERE event_type = 'error') - 1, 0)), 3600)::BIGINT AS wait FROM events GROUP BY user_id""")
def attempt_limits(spark, sf_dir):
    """Interrupted runs fail at the third, and wait twice as long each time before."""
    e = table(spark, sf_dir, "events")
    errors = F.count_if(F.col("event_type") == "error")
    by = e.groupBy("user_id").agg(F.count("*").alias("attempts"), errors.alias("errors"))
    wait = F.least(60 * F.pow(F.lit(2), F.greatest(F.col("errors") - 1, F.lit(0))), F.lit(3600)).cast("long")
    return by.select("user_id", "attempts", F.when(F.col("errors") >= 3, "failed").otherwise("queued").alias("state"), wait.alias("wait"))
