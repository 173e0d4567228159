"""Queries of greedy choices made in rounds, and of choices along walks."""

from pyspark.sql import functions as F

from plumbline.operators import paths, rounds
from plumbline.registry import query
from plumbline.tables import table

#: Vectors as points of walks, one a label, and as pieces of rooms of 250 vectors.
_WALKS = "v AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xy")])


def _by_vec_id():
    return F.floor(F.col("vec_id") / 4096)


@query("keyframes", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, n, event_id, t, t AS last_t, value AS last_value, true AS kept FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, t, CASE WHEN k THEN t ELSE last_t END, CASE WHEN k THEN value ELSE last_value END, k
      FROM (SELECT e.*, last_t, last_value, e.t - last_t >= 86400 OR (e.t - last_t >= 3600 AND abs(e.value - last_value) >= 100) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT user_id, event_id, t AS "at" FROM s WHERE kept""")
def keyframes(spark, sf_dir):
    """T10 in batch, L13: rows kept by time since, and change from, the last one kept."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"), "value", F.struct("ts", "event_id").alias("order"))
    kept = paths.keyframes(e, ["user_id"], "order", F.to_date("order.ts"), "at", ["value"], least_gap=3600.0, most_gap=86400.0, least_move=100.0)
    return kept.select("user_id", "event_id", "at")


@query("resampled_path", f"""WITH RECURSIVE {_WALKS},
    s AS (SELECT label, n, vec_id, x, y, true AS kept FROM v WHERE n = 1
      UNION ALL SELECT label, n, vec_id, CASE WHEN k THEN x ELSE lx END, CASE WHEN k THEN y ELSE ly END, k
      FROM (SELECT v.*, s.x AS lx, s.y AS ly, sqrt((v.x - s.x) ** 2 + (v.y - s.y) ** 2) >= 0.25 AS k FROM s JOIN v ON v.label = s.label AND v.n = s.n + 1))
    SELECT label, vec_id FROM s WHERE kept""")
def resampled_path(spark, sf_dir):
    """W12."""
    return paths.resampled(_points(spark, sf_dir), ["label"], "vec_id", _by_vec_id(), ["x", "y"], 0.25).select("label", "vec_id")


@query("spaced_selection", f"""WITH RECURSIVE {_WALKS},
    s AS (SELECT label, n, [struct_pack(id := vec_id, x := x, y := y)] AS kept FROM v WHERE n = 1
      UNION ALL SELECT v.label, v.n, CASE WHEN len(list_filter(s.kept, lambda k: sqrt((k.x - v.x) ** 2 + (k.y - v.y) ** 2) < 0.25)) > 0 THEN s.kept
        ELSE list_append(s.kept, struct_pack(id := v.vec_id, x := v.x, y := v.y)) END FROM s JOIN v ON v.label = s.label AND v.n = s.n + 1)
    SELECT label, k.id AS vec_id FROM (SELECT label, unnest(max_by(kept, n)) AS k FROM s GROUP BY label)""")
def spaced_selection(spark, sf_dir):
    """O06."""
    kept = rounds.first_apart(_points(spark, sf_dir), ["label"], "vec_id", ["x", "y"], 0.25, touching=False)
    return kept.filter("kept_as = vec_id").select("label", "vec_id")


@query("densest_clusters", """WITH RECURSIVE v AS (SELECT vec_id // 250 AS room, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    s AS (SELECT room, list(struct_pack(id := vec_id, x := x, y := y)) AS l, NULL::BIGINT AS vec_id, NULL::BIGINT AS n FROM v GROUP BY room
      UNION ALL SELECT room, list_filter(l, lambda a: sqrt((a.x - best.x) ** 2 + (a.y - best.y) ** 2) > 0.1), best.id, -best.m
      FROM (SELECT room, l, list_sort(list_transform(l, lambda a: struct_pack(m := -len(list_filter(l, lambda b: sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1)), id := a.id, x := a.x, y := a.y)))[1] AS best FROM s WHERE len(l) > 0))
    SELECT room, vec_id, n FROM s WHERE vec_id IS NOT NULL""")
def densest_clusters(spark, sf_dir):
    """Pieces of a room with most others around them, and how many of these they are the first to cover."""
    v = _points(spark, sf_dir).withColumn("room", F.floor(F.col("vec_id") / 250))
    return rounds.densest(v, ["room"], "vec_id", ["x", "y"], 0.1)


@query("complete_link_groups", """WITH RECURSIVE p AS (SELECT p_partkey // 200 AS room, p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y, row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) AS n FROM part),
    s AS (SELECT room, n, [struct_pack(id := p_partkey, f := p_partkey, x := x, y := y)] AS members, [p_partkey] AS founders FROM p WHERE n = 1
      UNION ALL SELECT room, n, list_append(members, struct_pack(id := p_partkey, f := coalesce(f, p_partkey), x := x, y := y)), CASE WHEN f IS NULL THEN list_append(founders, p_partkey) ELSE founders END
      FROM (SELECT p.*, members, founders, list_filter(founders, lambda f: len(list_filter(members, lambda m: m.f = f AND sqrt((m.x - p.x) ** 2 + (m.y - p.y) ** 2) > 3.0)) = 0)[1] AS f
            FROM s JOIN p ON p.room = s.room AND p.n = s.n + 1))
    SELECT room, m.id AS p_partkey, m.f AS cluster FROM (SELECT room, unnest(max_by(members, n)) AS m FROM s GROUP BY room)""")
def complete_link_groups(spark, sf_dir):
    """Sightings join the first group all of whose members they are compatible with."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 200).alias("room"), "p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return rounds.complete_link(p, ["room"], "p_partkey", ["x", "y"], 3.0).select("room", "p_partkey", "cluster")


@query("cross_walk_solids", """WITH RECURSIVE p AS (SELECT p_partkey // 200 AS room, p_partkey AS solid, p_partkey % 2 AS walk, (p_retailprice - 900) / 20 AS x,
      row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey % 3, p_size DESC, p_partkey) AS n FROM part),
    s AS (SELECT room, n, solid, solid AS kept_as, [struct_pack(id := solid, w := walk, x := x)] AS kept FROM p WHERE n = 1
      UNION ALL SELECT room, n, solid, coalesce(same, solid), CASE WHEN same IS NULL THEN list_append(kept, struct_pack(id := solid, w := walk, x := x)) ELSE kept END
      FROM (SELECT p.*, kept, list_filter(kept, lambda k: k.w <> p.walk AND abs(k.x - p.x) <= 1.0)[1].id AS same FROM s JOIN p ON p.room = s.room AND p.n = s.n + 1))
    SELECT room, solid, kept_as FROM s""")
def cross_walk_solids(spark, sf_dir):
    """Solids in order of quality and size; one that is a kept solid from another walk is dropped for it."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.floor(k / 200).alias("room"), k.alias("solid"), (k % 2).alias("walk"), (k % 3).alias("rank"), F.col("p_size").alias("volume"), ((F.col("p_retailprice") - 900) / 20).alias("x"))
    named = rounds.first_apart(p.select("room", "solid", "walk", "rank", "volume", "x"), ["room"], "solid", ["x"], 1.0, order=[F.col("rank"), -F.col("volume")], side="walk")
    return named.select("room", "solid", "kept_as")


@query("reversals", f"""WITH {_WALKS}, p AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM v WINDOW w AS (PARTITION BY label ORDER BY n)),
    a AS (SELECT *, sum(step) OVER (PARTITION BY label ORDER BY n) AS arc, max(n) OVER (PARTITION BY label) AS last FROM p),
    t AS (SELECT i.*, look, (SELECT min(b.n) FROM a b WHERE b.label = i.label AND b.arc >= i.arc - look) AS nb, (SELECT min(c.n) FROM a c WHERE c.label = i.label AND c.arc >= i.arc + look) AS nc
      FROM a i, (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::DOUBLE AS look) WHERE i.n > 1 AND i.n < i.last AND i.arc >= look),
    u AS (SELECT t.label, t.vec_id, t.n, look, t.x - b.x AS bx, t.y - b.y AS bw, c.x - t.x AS cx, c.y - t.y AS cy, sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2) AS chord, c.arc - b.arc AS long
      FROM t JOIN a b ON b.label = t.label AND b.n = t.nb JOIN a c ON c.label = t.label AND c.n = t.nc),
    d AS (SELECT *, degrees(acos(greatest(-1, least(1, (bx * cx + bw * cy) / (sqrt(bx * bx + bw * bw) * sqrt(cx * cx + cy * cy)))))) AS deg FROM u WHERE chord <= 0.65 * long AND (bx <> 0 OR bw <> 0) AND (cx <> 0 OR cy <> 0))
    SELECT label, vec_id, round(deg, 4) AS degrees FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(deg, 9) DESC, look, n) = 1""")
def reversals(spark, sf_dir):
    """The sharpest change of direction along a path, over several look distances."""
    turns = paths.sharpest_turns(_points(spark, sf_dir), ["label"], "vec_id", _by_vec_id())
    return turns.select("label", "vec_id", F.round("degrees", 4).alias("degrees"))
