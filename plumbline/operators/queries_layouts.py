"""Queries of layout changes, evaluation loops, and kernels of solids."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import kernels, layouts, solids
from plumbline.registry import query
from plumbline.tables import table

BEFORE = "SELECT p_partkey AS id, 0.5 + (p_partkey % 50) / 10.0::DOUBLE AS x, 0.5 + (p_partkey % 70) / 10.0::DOUBLE AS y, p_size / 50.0::DOUBLE AS width, p_size / 40.0::DOUBLE AS depth, p_partkey % 3 <> 0 AS movable FROM part"
MOVED = f"SELECT id, x + (id % 5) * 0.3::DOUBLE AS x, y, CASE WHEN id % 11 = 0 THEN width + 0.1 ELSE width END AS width, depth FROM ({BEFORE}) WHERE id % 17 <> 0"


def pieces(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("id"), (0.5 + (k % 50) / 10.0).alias("x"), (0.5 + (k % 70) / 10.0).alias("y"), (size / 50.0).alias("width"), (size / 40.0).alias("depth"), (k % 3 != 0).alias("movable"))


def moved(before):
    width = F.when(F.col("id") % 11 == 0, F.col("width") + 0.1).otherwise(F.col("width"))
    return before.filter("id % 17 <> 0").select("id", (F.col("x") + (F.col("id") % 5) * 0.3).alias("x"), "y", width.alias("width"), "depth")


@query("layout_violations", f"""WITH b AS ({BEFORE}), a AS ({MOVED}), j AS (SELECT b.id, b.x, b.y, b.width, movable, a.id AS n, a.x AS nx, a.width AS nw, a.depth AS nd, a.y AS ny, abs(a.x - b.x) AS d FROM b LEFT JOIN a USING (id))
    SELECT id, 'removed' AS violation FROM j WHERE n IS NULL UNION ALL SELECT id, 'locked_move' FROM j WHERE NOT movable AND d > 1e-6 UNION ALL SELECT id, 'resized' FROM j WHERE abs(nw - width) > 1e-6
    UNION ALL SELECT id, 'off_floor' FROM j WHERE d > 1e-6 AND (nx - nw / 2 < 0 OR ny - nd / 2 < 0 OR nx + nw / 2 > 6 OR ny + nd / 2 > 8) UNION ALL SELECT id, 'too_far' FROM j WHERE d > 1""")
def layout_violations(spark, sf_dir):
    """What a new layout may not do."""
    before = pieces(spark, sf_dir)
    return layouts.violations(before, moved(before), 1.0, (6.0, 8.0))


@query("layout_collisions", f"""WITH b AS (SELECT *, id // 50 AS scene FROM ({BEFORE})) SELECT p.id, o.id AS other FROM b p JOIN b o ON p.scene = o.scene AND p.id < o.id AND abs(p.x - o.x) < (p.width + o.width) / 2 - 1e-9 AND abs(p.y - o.y) < (p.depth + o.depth) / 2 - 1e-9""")
def layout_collisions(spark, sf_dir):
    """In scenes of fifty pieces."""
    return layouts.collisions(pieces(spark, sf_dir).withColumn("scene", F.floor(F.col("id") / 50)), 1.8, group="scene")


@query("usability_by_brand", """SELECT p_brand, round(coalesce(avg(CASE WHEN p_size > 0 THEN least(1.0, (p_partkey % 60) / p_size) END), 1), 6) AS usable FROM part GROUP BY p_brand""")
def usability_by_brand(spark, sf_dir):
    """L08."""
    p = table(spark, sf_dir, "part").withColumn("now", (F.col("p_partkey") % 60).cast("double"))
    return p.groupBy("p_brand").agg(layouts.usability("now", "p_size").alias("usable"))


@query("rewards", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag <> 'N' THEN greatest(0.05, least(1.0, 0.6::DOUBLE * l_discount * 10 + 0.4::DOUBLE * (1 - l_tax))) ELSE 0 END, 6) AS reward FROM lineitem""")
def rewards(spark, sf_dir):
    """L06, G43."""
    value = layouts.reward(F.col("l_returnflag") != "N", F.col("l_discount") * 10, 1 - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("reward"))


@query("pinned_pieces", """SELECT p_partkey, nullif(concat_ws(',', CASE WHEN p_size > 45 THEN 'too_large' END, CASE WHEN p_retailprice < 950 THEN 'low_confidence' END, CASE WHEN p_partkey % 10 = 0 THEN 'floating' END), '') AS pinned_for FROM part""")
def pinned_pieces(spark, sf_dir):
    """L10."""
    reasons = {"too_large": F.col("p_size") > 45, "low_confidence": F.col("p_retailprice") < 950, "floating": F.col("p_partkey") % 10 == 0}
    return layouts.pins(table(spark, sf_dir, "part"), reasons).select("p_partkey", "pinned_for")


@query("experiment_grid", """SELECT r_regionkey, cell, ladder FROM region, (SELECT unnest([20, 25, 30]) AS cell), (SELECT unnest([4, 16]) AS ladder)""")
def experiment_grid(spark, sf_dir):
    """L11, L12."""
    return layouts.experiment_grid(table(spark, sf_dir, "region").select("r_regionkey"), {"cell": [20, 25, 30], "ladder": [4, 16]})


@query("better_run", """WITH t AS (SELECT event_type AS scorer, sum(CAST(value AS DECIMAL(18, 2))) AS o, sum(CAST(value AS DECIMAL(18, 2)) + CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 2 END) AS n FROM events GROUP BY 1)
    SELECT sum(CASE WHEN scorer <> 'error' THEN n - o END)::DOUBLE AS gain, NOT bool_or(scorer <> 'error' AND n < o) AND NOT bool_or(scorer = 'error' AND n > o) AND sum(CASE WHEN scorer <> 'error' THEN n - o END) > 0 AS accepted FROM t""")
def better_run(spark, sf_dir):
    """L18."""
    old = F.col("value").cast("decimal(18,2)")
    new = old + F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 2)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.col("event_type").alias("scorer"), old.alias("old"), new.alias("new"))
    return layouts.better_run(rows, "error").select(F.col("gain").cast("double").alias("gain"), "accepted")


@query("how_runs_end", """WITH s AS (SELECT user_id AS run, row_number() OVER w AS pass, event_type AS action, lag(event_type) OVER w = event_type AS again, sum((value < 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT run, pass, CASE WHEN action = 'purchase' THEN 'done' WHEN action = 'error' THEN 'rejected' WHEN coalesce(again, false) THEN 'stalled' WHEN f >= 3 THEN 'failing' WHEN pass >= 20 THEN 'passes' END AS ended FROM s)
    SELECT run, arg_min(ended, pass) AS ended, min(pass) AS passes FROM r WHERE ended IS NOT NULL GROUP BY run""")
def how_runs_end(spark, sf_dir):
    """L15, W09, W10."""
    from pyspark.sql import Window as W

    action = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "reject").otherwise(F.col("event_type"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), place.alias("pass"), action.alias("action"), F.lit(0).alias("state"), (F.col("value") >= 20).alias("ok"))
    return layouts.how_runs_end(steps, 20, 3)


@query("policy_verdicts", """SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_custkey % 7 = 0 THEN 'rejected' WHEN c_acctbal <= 0 THEN 'blocked' ELSE printf('%.4f', (c_custkey % 100) / 100.0::DOUBLE) END AS status FROM customer""")
def policy_verdicts(spark, sf_dir):
    """L14."""
    status = layouts.policy_verdict(F.col("c_acctbal") > 0, F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 100) / 100.0)
    return table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"))


@query("duplicate_frames", """SELECT vec_id, coalesce(vec_id - lag(vec_id) OVER w <= 12 AND sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) <= 0.3 AND least(abs(h - lag(h) OVER w) % 360, 360 - abs(h - lag(h) OVER w) % 360) <= 40, false) AS duplicate
    FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (vec_id * 37 % 360)::DOUBLE AS h FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def duplicate_frames(spark, sf_dir):
    """L13."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").alias("at"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xy")], (F.col("vec_id") * 37 % 360).cast("double").alias("heading"))
    return layouts.near_duplicate_split(e, "label", ["vec_id"], 12, 0.3, 40).select("vec_id", "duplicate")


@query("picked_frames")
def picked_frames(spark, sf_dir):
    """Up to six frames a walk, each separated from all picked before; tests compare it with a loop."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("frame"), F.col("vec_id").cast("double").alias("at"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xy")], (F.col("vec_id") * 37 % 360).cast("double").alias("heading"))
    return layouts.picked_frames(e, "label", 40.0, 0.3, 90.0)


@query("solid_kernels")
def solid_kernels(spark, sf_dir):
    """Kernels over the points of each label."""

    def kernel(pdf):
        p = np.stack(pdf.sort_values("vec_id")["p"].to_numpy()).astype(float)
        box = solids.fit_box(p, least=0.001)
        turned = p[:, :2] @ np.array([[0.0, 1.0], [-1.0, 0.0]]) + [1.0, 2.0]
        yaw, _ = solids.register(p[:, :2], turned, 0.01)
        cells = np.unique(np.floor(p / 0.2).astype(int), axis=0)
        triangles = np.arange(len(p) // 3 * 3).reshape(-1, 3)
        apart = solids.box_distance((p[0], np.full(3, 0.05), np.eye(3)), (p[1] + 1, np.full(3, 0.05), np.eye(3)))
        bits = solids.packed_bits(p[:, :2] > 0)
        return {
            "volume": round(float(np.prod(box[1])), 6) if box else None, "yaw": round(yaw, 6), "parts": int(solids.voxel_components(cells).max() + 1),
            "slope": solids.steepest(p, triangles), "apart": round(apart, 6), "same_bits": bool((solids.unpacked_bits(bits, (len(p), 2)) == (p[:, :2] > 0)).all()),
        }

    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("p"))
    return kernels.per_room(e, "label", kernel, "volume double, yaw double, parts int, slope double, apart double, same_bits boolean")
