"""Queries of job queues, retention and admission, over orders and events."""

from pyspark.sql import functions as F

from plumbline.registry import query
from plumbline.streaming import jobs
from plumbline.tables import table

STATE = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END"


def _jobs(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("kind"), F.when(status == "O", "queued").when(status == "P", "running").otherwise("done").alias("state"),
        (F.col("o_orderkey") % 4).alias("interruptions"), F.col("o_orderdate").cast("timestamp").alias("started"), F.col("o_custkey").alias("owner"),
    )


@query("claimed_jobs", f"""WITH j AS (SELECT o_orderkey AS job, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE {STATE} = 'queued'),
    w AS (SELECT s_suppkey AS worker, (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[(s_suppkey % 5 + 1)::INT] AS kind, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS place FROM supplier) SELECT job, worker FROM j JOIN w USING (kind, place)""")
def claimed_jobs(spark, sf_dir):
    """Each worker claims one job of its lane, and no job has two."""
    kinds = F.array(*[F.lit(k) for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    workers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("kind"))
    return jobs.claims(_jobs(spark, sf_dir), workers, "kind", ["started", "job"])


@query("recovered_jobs", f"""SELECT job, CASE WHEN state = 'running' THEN i + 1 ELSE i END AS interruptions, CASE WHEN state = 'running' AND i + 1 >= 3 THEN 'failed' WHEN state = 'running' THEN 'queued' ELSE state END AS state, CASE WHEN i < 1 THEN 0 ELSE least(200, 30 * 2 ** (i - 1)) END::DOUBLE AS wait
    FROM (SELECT o_orderkey AS job, o_orderkey % 4 AS i, {STATE} AS state FROM orders)""")
def recovered_jobs(spark, sf_dir):
    """Jobs after a restart, and how long each would have waited by its interruptions before."""
    found = jobs.recovered(_jobs(spark, sf_dir).withColumn("wait", jobs.backoff(F.col("interruptions"), 30.0, 200.0)), 3)
    return found.select("job", "interruptions", "state", "wait")


@query("overdue_jobs", f"""SELECT o_orderkey AS job FROM orders WHERE {STATE} = 'running' AND ((o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 400 DAY) OR (o_orderpriority = '5-LOW' AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 900 DAY))""")
def overdue_jobs(spark, sf_dir):
    """Running jobs past their kind's deadline."""
    return jobs.overdue(_jobs(spark, sf_dir), F.lit("2000-01-01").cast("timestamp"), {"1-URGENT": 400 * 86400, "5-LOW": 900 * 86400}).select("job")


@query("swept_guests", """SELECT k, CASE WHEN age >= 30 THEN 'delete' WHEN age >= 23 AND (r IS NULL OR r < o) THEN 'remind' ELSE 'keep' END AS action FROM (SELECT user_id AS k, max(ts) AS o, max(ts) FILTER (WHERE event_type = 'error') + INTERVAL 1 HOUR AS r, (epoch_us(TIMESTAMP '2024-02-20') - epoch_us(max(ts))) / 86400e6 AS age FROM events GROUP BY user_id)""")
def swept_guests(spark, sf_dir):
    """guests' data goes after thirty days, with a reminder a week before."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = e.groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("opened"), (F.max(F.when(F.col("event_type") == "error", F.col("ts"))) + F.expr("interval 1 hour")).alias("reminded"))
    return jobs.swept(by, F.lit("2024-02-20").cast("timestamp"), 30, 7).select("k", "action")


@query("reserved_bytes", """WITH RECURSIVE o AS (SELECT o_custkey AS owner, o_orderkey AS job, trunc(o_totalprice)::BIGINT AS bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    s AS (SELECT owner, job, n, (bytes <= 600000)::INT AS c, CASE WHEN bytes <= 600000 THEN bytes ELSE 0 END AS b, bytes <= 600000 AS admitted FROM o WHERE n = 1
      UNION ALL SELECT owner, job, n, c + f::INT, b + CASE WHEN f THEN bytes ELSE 0 END, f FROM (SELECT o.*, s.c, s.b, s.c < 5 AND s.b + o.bytes <= 600000 AS f FROM s JOIN o ON o.owner = s.owner AND o.n = s.n + 1))
    SELECT owner, job, admitted FROM s""")
def reserved_bytes(spark, sf_dir):
    """A count and a byte budget an owner; tests compare it with a loop."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("job"), F.col("o_totalprice").cast("long").alias("bytes"))
    return jobs.reserved(o, "owner", "job", "bytes", 5, 600_000)


@query("clicks_then_purchases", """SELECT a.event_id AS first, b.event_id AS "then" FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def clicks_then_purchases(spark, sf_dir):
    """Purchases up to six hours after a click; the same join runs over two streams."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.followed(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "ts", "6 hours").select("first", "then")
