"""Queries of the streaming operators, over a batch of events."""

from pyspark.sql import functions as F

from plumbline.registry import query
from plumbline.streaming import evidence, jobs
from plumbline.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("settled_bursts", """SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000000 AS first, epoch_us(max(ts)) // 1000000 AS last FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g""")
def settled_bursts(spark, sf_dir):
    """T07."""
    return jobs.settled(_events(spark, sf_dir), "user_id", "ts", "6 hours").select("user_id", "n", F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"))


@query("hourly_counts", """SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(spark, sf_dir):
    """T16 in idiomatic form: tumbling windows."""
    return jobs.windowed_counts(_events(spark, sf_dir), ["event_type"], "ts", "1 hour").withColumn("start", F.unix_seconds("start"))


@query("trailing_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def trailing_limit(spark, sf_dir):
    """Events in the trailing day."""
    return jobs.trailing_counts(_events(spark, sf_dir), "user_id", "ts", 86400.0, 3).select("event_id", "in_window")


@query("admitted_events", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, event_id, n, [t] AS times, true AS admitted FROM e WHERE n = 1
      UNION ALL SELECT user_id, event_id, n, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END, len(l) < 3
      FROM (SELECT e.*, list_filter(s.times, lambda x: x > e.t - 86400000000) AS l FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT user_id, event_id, admitted FROM s""")
def admitted_events(spark, sf_dir):
    """Refused events don't count against the limit."""
    return jobs.admitted(_events(spark, sf_dir).select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", 86400.0, 3)


@query("sampled_frames", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, event_id * 7 % 360 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, n, event_id, t, value, h, true AS kept FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, CASE WHEN k THEN t ELSE lt END, CASE WHEN k THEN value ELSE lv END, CASE WHEN k THEN h ELSE lh END, k
      FROM (SELECT e.*, s.t AS lt, s.value AS lv, s.h AS lh, e.t - s.t >= 86400 OR (e.t - s.t >= 3600 AND (abs(e.value - s.value) >= 100)) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT user_id, event_id FROM s WHERE kept""")
def sampled_frames(spark, sf_dir):
    """T10, T11."""
    return jobs.sampled(_events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", "event_id", "ts", "value", 3600.0, 86400.0, 100.0)


@query("walk_frames", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, event_id * 7 % 360 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT user_id, n, event_id, t, value, h, true AS kept FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, event_id, CASE WHEN k THEN t ELSE lt END, CASE WHEN k THEN value ELSE lv END, CASE WHEN k THEN h ELSE lh END, k
      FROM (SELECT e.*, s.t AS lt, s.value AS lv, s.h AS lh, e.t - s.t >= 43200 OR (e.t - s.t >= 1800 AND (abs(e.value - s.value) >= 100 OR least(abs(e.h - s.h), 360 - abs(e.h - s.h)) >= 8)) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT user_id, event_id FROM s WHERE kept""")
def walk_frames(spark, sf_dir):
    """A user's events as a walk, with a turn of eight degrees; tests compare it with a loop."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value", (F.col("event_id") * 7 % 360).cast("double").alias("heading"))
    return jobs.sampled(e, "user_id", "event_id", "ts", "value", 1800.0, 43200.0, 100.0, heading="heading")


@query("due_bundles", """WITH b AS (SELECT o_custkey AS k, o_orderkey AS version, o_orderstatus <> 'P' AS complete, o_orderpriority AS manifest, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'old' END AS processed, o_orderkey % 5 = 0 AS photos FROM orders),
    l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC) = 1), n AS (SELECT user_id AS k, max(ts) AS newest FROM events GROUP BY 1)
    SELECT k, version, why FROM (SELECT l.k, version, CASE WHEN photos THEN 'photos' WHEN newest IS NULL THEN 'nothing came' WHEN newest <= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY THEN 'settled' END AS why FROM l LEFT JOIN n ON n.k = l.k WHERE complete AND processed IS DISTINCT FROM manifest) WHERE why IS NOT NULL""")
def due_bundles(spark, sf_dir):
    """Bundles with photos at once, those that nothing came for, and the rest once arrivals have settled."""
    k = F.col("o_orderkey")
    bundles = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), k.alias("version"), (F.col("o_orderstatus") != "P").alias("complete"), F.col("o_orderpriority").alias("manifest"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, "old").alias("processed"), (k % 5 == 0).alias("photos"),
    )
    arrivals = _events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("ts").alias("at"))
    return jobs.due(bundles, arrivals, "k", F.lit("2024-01-20").cast("timestamp"), 86400.0)


@query("evidence_versions", """SELECT user_id, version, event_id, items FROM (SELECT user_id, event_id, row_number() OVER w AS version, list_sort(list_distinct(list(event_type) OVER (w ROWS UNBOUNDED PRECEDING))).array_to_string(',') AS items
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id, event_type))""")
def evidence_versions(spark, sf_dir):
    """Late evidence makes a new version."""
    return jobs.versions(_events(spark, sf_dir), "user_id", "event_id", "event_type").select("user_id", "version", "event_id", "items")


@query("late_evidence", """WITH e AS (SELECT user_id, event_type, ts, row_number() OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS wait, epoch_us(lead(ts) OVER w) AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
    r AS (SELECT *, sum(CASE WHEN wait >= 259200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY n) AS version, list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id, run ORDER BY n ROWS UNBOUNDED PRECEDING))).array_to_string(',') AS items FROM r)
    SELECT user_id, 'version' AS kind, version, items, epoch_us(ts) AS at FROM v UNION ALL SELECT user_id, 'settled', version, items, epoch_us(ts) + 43200000000 FROM v WHERE coalesce(nxt, epoch_us(TIMESTAMP '2024-03-01')) - epoch_us(ts) >= 43200000000""")
def late_evidence(spark, sf_dir):
    """Versions of what a user has sent so far, those that half a day's quiet settles, and new bundles after three days'."""
    found = evidence.closures(_events(spark, sf_dir), "user_id", "event_type", "ts", 43200.0, 259200.0, now="2024-03-01")
    return found.select("user_id", "kind", "version", "items", F.unix_micros("at").alias("at"))
