"""Queries that write through the sinks and read what was written, and of coverage documents, vectors and topics."""

from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions import vectors as V
from plumbline.registry import query
from plumbline.sources import io, publish
from plumbline.tables import shared_folder, table


@query("published_orders", """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders""")
def published_orders(spark, sf_dir):
    """Orders that meet their rules, published as a whole, once, and read by their digest."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = shared_folder(spark)
    name = publish.publish(rows, path, {"keyed": F.col("o_orderkey").isNotNull(), "priced": F.col("o_totalprice") >= 0}, "json")
    return publish.read_published(spark, path, name)


@query("logged_events", """SELECT event_id, user_id, event_type, value FROM events""")
def logged_events(spark, sf_dir):
    """A log of two appends."""
    rows, path = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), shared_folder(spark)
    io.append_log(rows.filter("event_id % 3 = 0"), path)
    io.append_log(rows.filter("event_id % 3 <> 0"), path)
    return io.read_log(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("exported_customers", """SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def exported_customers(spark, sf_dir):
    """Customers as CSV in order, read again."""
    path = shared_folder(spark)
    io.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ["c_mktsegment", "c_custkey"])
    return spark.read.option("header", True).schema("c_custkey long, c_name string, c_mktsegment string").csv(path)


@query("result_grid", """SELECT setting, event_type AS scorer, round(avg(value), 6) AS mean FROM (SELECT event_type, user_id % 4 AS setting, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events) GROUP BY ALL""")
def result_grid(spark, sf_dir):
    """An evaluation's cases, means and grid, of which the grid is read."""
    rows, path = table(spark, sf_dir, "events"), shared_folder(spark)
    score = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    io.write_results(rows.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("scorer"), score.alias("score"), (F.col("user_id") % 4).alias("setting")), path, "case_id", "scorer", "score", "setting")
    return spark.read.schema("setting long, scorer string, mean double").json(f"{path}/grid").withColumn("mean", F.round("mean", 6))


@query("training_rows", """SELECT CASE WHEN conv_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, conv_id, count(*) AS turns, sum(length(text))::BIGINT AS letters FROM conversations GROUP BY ALL""")
def training_rows(spark, sf_dir):
    """Conversations as training rows, a line each, in a folder for each split."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))  # a conversation is bounded
    path = shared_folder(spark)
    io.write_splits(rows.withColumn("split", F.when(F.col("conv_id") % 10 == 0, "test").otherwise("train")), path)
    back = spark.read.schema("conv_id long, messages array<struct<turn: long, role: string, text: string>>, split string").json(path)
    letters = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m["text"]))
    return back.select("split", "conv_id", F.size("messages").cast("long").alias("turns"), letters.alias("letters"))


def _coverage(spark, sf_dir):
    k = F.col("p_partkey")
    node = F.struct(k.cast("string").alias("node_id"), F.when(k % 13 != 0, F.col("p_size") / 50.0).alias("observed_fraction"), (k % 4).cast("int").alias("viewpoint_count"))
    docs = table(spark, sf_dir, "part").groupBy(F.floor(k / 50).cast("string").alias("path")).agg(F.to_json(F.collect_list(node)).alias("doc"))  # fifty nodes a document
    return io.coverage(docs.union(spark.createDataFrame([("x", "not json"), ("y", None)], "path string, doc string")))


@query("coverage_documents", """SELECT p_partkey // 50 AS scene, p_partkey AS node, p_partkey % 13 <> 0 AND p_size / 50.0 >= 0.7 AND p_partkey % 4 >= 2 AS done FROM part""")
def coverage_documents(spark, sf_dir):
    """Nodes of coverage documents, and whether they are seen well enough."""
    return _coverage(spark, sf_dir).select(F.col("path").cast("long").alias("scene"), F.col("node_id").cast("long").alias("node"), "done")


@query("coverage_floors_met", """WITH s AS (SELECT p_partkey // 50 % 7 AS module, avg(CASE WHEN p_partkey % 13 <> 0 AND p_size / 50.0 >= 0.7 AND p_partkey % 4 >= 2 THEN 1.0 ELSE 0 END) AS share FROM part GROUP BY 1), f AS (SELECT n_nationkey AS module, n_regionkey / 20 AS floor FROM nation WHERE n_nationkey BETWEEN 1 AND 8)
    SELECT module, round(share, 6) AS share, floor, coalesce(share, 0) >= floor AS met FROM s FULL JOIN f USING (module)""")
def coverage_floors_met(spark, sf_dir):
    """Each module's share of done nodes against its floor; modules without one of the two stay."""
    covered = _coverage(spark, sf_dir).withColumn("module", F.col("path").cast("long") % 7)
    floors = table(spark, sf_dir, "nation").filter("n_nationkey between 1 and 8").select(F.col("n_nationkey").alias("module"), (F.col("n_regionkey") / 20).alias("floor"))
    return io.floors_met(covered, floors, "module").withColumn("share", F.round("share", 6))


@query("box_corners", """WITH b AS (SELECT p_partkey AS id, radians(p_partkey * 37 % 360) AS a, (p_partkey % 90)::DOUBLE AS cx, (p_partkey % 70)::DOUBLE AS cy, p_size / 10.0::DOUBLE AS w, (p_partkey % 9 + 1)::DOUBLE AS d FROM part)
    SELECT id, round(cx - (abs(cos(a)) * w + abs(sin(a)) * d) / 2, 6) AS low_x, round(cy + (abs(sin(a)) * w + abs(cos(a)) * d) / 2, 6) AS high_y, round(-cx * cos(a) - cy * sin(a), 6) + 0.0::DOUBLE AS origin_x, round(cx * sin(a) - cy * cos(a), 6) + 0.0::DOUBLE AS origin_y FROM b""")
def box_corners(spark, sf_dir):
    """The bounds of boxes' corners, and the room's origin as each box sees it."""
    k = F.col("p_partkey")
    a, zero, one = F.radians(k * 37 % 360), F.lit(0.0), F.lit(1.0)
    matrix = F.array(F.cos(a), -F.sin(a), zero, (k % 90).cast("double"), F.sin(a), F.cos(a), zero, (k % 70).cast("double"), zero, zero, one, zero, zero, zero, zero, one)
    b = table(spark, sf_dir, "part").select(k.alias("id"), matrix.alias("m"), (F.col("p_size") / 10.0).alias("w"), (k % 9 + 1).cast("double").alias("d"))
    b = b.select("id", V.corners(F.col("m"), F.col("w"), F.col("d"), one).alias("c"), V.applied(V.inverse(F.col("m")), F.array(zero, zero, zero)).alias("o"))
    edge = lambda pick, i: F.round(pick(F.transform("c", lambda p: p[i])), 6)
    return b.select("id", edge(F.array_min, 0).alias("low_x"), edge(F.array_max, 1).alias("high_y"), (F.round(F.col("o")[0], 6) + 0.0).alias("origin_x"), (F.round(F.col("o")[1], 6) + 0.0).alias("origin_y"))


@query("relation_scores", """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (vec_id * 77 % 720 - 360)::DOUBLE AS heading FROM embeddings),
    t AS (SELECT *, least(h, 360 - h) AS turned, sqrt(x * x + y * y) AS moved FROM (SELECT *, (heading - 90) - 360 * floor((heading - 90) / 360) AS h FROM v))
    SELECT vec_id, turned + 0.0::DOUBLE AS turned, round(degrees(acos(greatest(-1, least(1, x / sqrt(x * x + y * y + z * z))))), 6) AS off_axis, round(0.5 ** (turned / 45) * 0.5 ** (moved / 0.25), 9) AS score, round(log2(1 + moved), 9) AS bits FROM t""")
def relation_scores(spark, sf_dir):
    """Turns by the shorter way, angles held in range, decays and logarithms."""
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    moved, turned = F.hypot(e[0], e[1]), V.turned((F.col("vec_id") * 77 % 720 - 360).cast("double"), F.lit(90.0))
    off = V.angle(F.array(*e), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    score = V.decayed(turned, 45.0) * V.decayed(moved, 0.25)
    return table(spark, sf_dir, "embeddings").select("vec_id", (turned + 0.0).alias("turned"), F.round(off, 6).alias("off_axis"), F.round(score, 9).alias("score"), F.round(F.log2(1 + moved), 9).alias("bits"))


@query("compared_measures", """SELECT p_partkey, CASE WHEN abs(p_retailprice / 1000 - p_size / 20.0) <= 0.01 THEN 0 WHEN p_retailprice / 1000 < p_size / 20.0 THEN -1 ELSE 1 END AS cmp, p_partkey % 3 <> p_partkey % 4 AS differently FROM part""")
def compared_measures(spark, sf_dir):
    """Less, equal within a centimetre or more, and whether the two were measured in different ways."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", X.three_way(F.col("p_retailprice") / 1000, F.col("p_size") / 20.0).alias("cmp"), (k % 3 != k % 4).alias("differently"))


#: Words of questions and the checks they ask about, a row each: fixed values.
TOPICS = [
    ("ring", "reach_range"), ("rod", "grab_bars"), ("rod", "reach_range"), ("plate", "dining_surface_height"), ("widget", "kiosk_reach"), ("bolt", "door_clear_width"), ("gear", "ramp_slope"), ("gizmo", "kiosk_reach"),
    ("gizmo", "point_of_sale_height"), ("small", "turning_space"), ("large", "route_clear_width"), ("cold", "lavatory_rim"), ("hot", "lavatory_rim"),
]


@query("asked_checks", f"""WITH t AS (SELECT unnest({[w for w, _ in TOPICS]}) AS word, unnest({[c for _, c in TOPICS]}) AS "check") SELECT DISTINCT p_partkey, "check" FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) JOIN t USING (word)""")
def asked_checks(spark, sf_dir):
    """The checks that a question's words ask about, from a dictionary."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return words.join(spark.createDataFrame(TOPICS, "word string, check string"), "word").select("p_partkey", "check").distinct()


@query("repeated_outcomes", """SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL HAVING count(*) > 1""")
def repeated_outcomes(spark, sf_dir):
    """What breaks a unique key that holds for some kinds of rows only."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).filter("n > 1")
