"""Queries of evaluation: arms, votes, histograms, campaigns, wishes and sweeps."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evaluation
from plumbline.registry import query
from plumbline.tables import table

ATTEMPTS = """SELECT l_shipdate < TIMESTAMP '1998-01-01' AS arm, l_orderkey AS "case", l_linestatus = 'F' OR l_quantity > 10 AS parsed, l_returnflag = 'R' AS accepted, l_returnflag <> 'N' AS resolved, l_tax > 0.04 AS cleared,
    l_discount * 10 AS reward, l_tax * 10 AS disruption, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity / 40 END AS usable, l_linenumber AS seconds, l_orderkey % 3 <> 0 AS ceiling FROM lineitem"""


@query("arm_summary", f"""WITH a AS ({ATTEMPTS}), c AS (SELECT arm, "case", bool_or(accepted) AS o, bool_and(accepted) AS e, bool_or(ceiling) AS could FROM a GROUP BY ALL)
    SELECT * FROM (SELECT arm, count(*) AS attempts, round(avg(parsed::INT), 4) AS parsed_rate, round(avg(accepted::INT), 4) AS accepted_rate, round(avg(resolved::INT), 4) AS resolved_rate, round(avg(cleared::INT), 4) AS cleared_rate, round(avg(reward), 4) AS reward,
    round(avg(reward) FILTER (WHERE accepted), 4) AS reward_if_accepted, round(avg(disruption) FILTER (WHERE accepted), 4) AS disruption_if_accepted, round(avg(usable) FILTER (WHERE accepted), 4) AS usable_if_accepted, count(usable) AS measured, count(*) - count(usable) AS missing,
    min(usable) AS least_usable, count(*) FILTER (WHERE usable < 1) AS below_one, max(seconds) AS slowest, count(*) FILTER (WHERE NOT parsed) AS unparsed FROM a GROUP BY arm)
    JOIN (SELECT arm, count(*) AS cases, round(avg(o::INT), 4) AS best_of, round(avg(e::INT), 4) AS all_of, round(count(*) FILTER (WHERE o AND could) / nullif(count(*) FILTER (WHERE could), 0), 4) AS of_ceiling FROM c GROUP BY arm) USING (arm)""")
def arm_summary(spark, sf_dir):
    """Rates, conditional means and case shares of each arm."""
    n = F.col("l_linenumber")
    a = table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate") < F.expr("timestamp '1998-01-01'")).alias("arm"), F.col("l_orderkey").alias("case"), ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 10)).alias("parsed"),
        (F.col("l_returnflag") == "R").alias("accepted"), (F.col("l_returnflag") != "N").alias("resolved"), (F.col("l_tax") > 0.04).alias("cleared"), (F.col("l_discount") * 10).alias("reward"),
        (F.col("l_tax") * 10).alias("disruption"), F.when(n % 3 != 0, F.col("l_quantity") / 40).alias("usable"), n.alias("seconds"), (F.col("l_orderkey") % 3 != 0).alias("ceiling"),
    )
    return evaluation.arm_summary(a, "arm")


@query("soft_votes", """WITH v AS (SELECT l_orderkey AS k, p_name AS name, string_split(p_name, ' ') AS w, (l_quantity)::BIGINT AS q FROM lineitem JOIN (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[2] ELSE p_name END AS p_name FROM part) ON p_partkey = l_partkey),
    b AS (SELECT k, name, any_value(w) AS w, sum(q) AS own FROM v GROUP BY k, name), m AS (SELECT a.k, a.name, a.own, sum(o.own) AS support FROM b a JOIN b o ON a.k = o.k AND (list_has_all(a.w, o.w) OR list_has_all(o.w, a.w)) GROUP BY ALL)
    SELECT k, name, support::BIGINT AS support, round(support / t, 4) AS share FROM m JOIN (SELECT k, sum(own) AS t FROM b GROUP BY k) USING (k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY support DESC, own DESC, name) = 1""")
def soft_votes(spark, sf_dir):
    """Names vote for names whose words they hold, or are held by."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[1]).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("name"))
    votes = table(spark, sf_dir, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("k"), "name", F.split("name", " ").alias("words"), F.col("l_quantity").cast("long").alias("weight"))
    return evaluation.soft_vote(votes, "k", T.agree)


@query("fullest_bins", """SELECT l_suppkey, bin, n, round(n / total, 4) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM (SELECT l_suppkey, floor(l_quantity / 5)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2))
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, bin) = 1 AND n >= 0.12 * total""")
def fullest_bins(spark, sf_dir):
    """A group's fullest bin, if it holds a least share."""
    return evaluation.fullest_bin(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 5.0, 0.12)


@query("bounds_and_centroids", """SELECT label, round(min(x), 6) AS low_x, round(max(x), 6) AS high_x, round(min(y), 6) AS low_y, round(max(y), 6) AS high_y, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label""")
def bounds_and_centroids(spark, sf_dir):
    """G30."""
    e = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xy")])
    each = [F.round(f(c), 6).alias(f"{n}_{c}") for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "centre")) for c in "xy"]
    return e.groupBy("label").agg(*each)


@query("route_campaign", """SELECT l_linenumber AS task, l_linestatus AS profile, count(*) FILTER (WHERE l_returnflag = 'R') AS fits, count(*) FILTER (WHERE l_returnflag = 'A') AS blocked, count(*) FILTER (WHERE l_returnflag = 'N') AS unknown FROM lineitem GROUP BY ALL""")
def route_campaign(spark, sf_dir):
    """Outcomes of each task and profile; the digest is tested for not depending on order."""
    outcome = F.when(F.col("l_returnflag") == "R", "fits").when(F.col("l_returnflag") == "A", "blocked").otherwise("unknown")
    o = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("task"), F.col("l_linestatus").alias("profile"), F.col("l_orderkey").alias("id"), outcome.alias("outcome"))
    return evaluation.campaign(o, "task", "profile", ["fits", "blocked", "unknown"]).drop("digest")


@query("wishes_kept", """SELECT o_custkey, round(1 - count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS kept FROM orders GROUP BY o_custkey""")
def wishes_kept(spark, sf_dir):
    """The share of wishes that a layout keeps."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(1 - F.count_if(F.col("o_orderstatus") == "P") / F.count("*"), 6).alias("kept"))


@query("knob_sweep", """SELECT least, count(*) AS cases, round(avg((l_quantity >= least)::INT), 6) AS recall, round(avg(CASE WHEN l_quantity >= least THEN l_discount END), 6) AS error FROM lineitem, (SELECT unnest([5, 15, 25, 35, 45]) AS least) GROUP BY least""")
def knob_sweep(spark, sf_dir):
    """One knob's values, with the metrics of each over all cases."""
    swept = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", F.explode(F.array(*[F.lit(v) for v in (5, 15, 25, 35, 45)])).alias("least"))
    over = F.col("l_quantity") >= F.col("least")
    return swept.groupBy("least").agg(F.count("*").alias("cases"), F.round(F.avg(over.cast("int")), 6).alias("recall"), F.round(F.avg(F.when(over, F.col("l_discount"))), 6).alias("error"))
