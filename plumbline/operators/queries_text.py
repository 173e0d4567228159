"""Queries of names, quantities, sentences and times."""

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import containment
from plumbline.registry import query
from plumbline.tables import table

NAME = "CASE WHEN p_partkey % 4 = 0 THEN 'The Sofa-' || p_name WHEN p_partkey % 4 = 1 THEN p_name || ' with a Bin' WHEN p_partkey % 4 = 2 THEN upper(p_name) || ', grab bar' ELSE p_name || '/desk of wc' END"


def _name():
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    return F.when(k == 0, F.concat(F.lit("The Sofa-"), n)).when(k == 1, F.concat(n, F.lit(" with a Bin"))).when(k == 2, F.concat(F.upper(n), F.lit(", grab bar"))).otherwise(F.concat(n, F.lit("/desk of wc")))


@query("name_words", f"""WITH n AS (SELECT p_partkey, {NAME} AS name FROM part), w AS (SELECT p_partkey, unnest(string_split_regex(lower(regexp_replace(name, '[-_/,.]+', ' ', 'g')), '\\s+')) AS w FROM n)
    SELECT p_partkey, string_agg(DISTINCT CASE w WHEN 'sofa' THEN 'couch' WHEN 'bin' THEN 'basket' WHEN 'wc' THEN 'toilet' ELSE w END, ' ' ORDER BY CASE w WHEN 'sofa' THEN 'couch' WHEN 'bin' THEN 'basket' WHEN 'wc' THEN 'toilet' ELSE w END) AS words
    FROM w WHERE w NOT IN ('', 'a', 'an', 'the', 'of', 'with', 'and') GROUP BY p_partkey""")
def name_words(spark, sf_dir):
    """Words of a name with aliases in place and stop words left out."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.words(_name()), " ").alias("words"))


@query("piece_roles", f"""WITH n AS (SELECT p_partkey, lower({NAME}) AS name FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(name, 'grab bar') THEN 'bar' END, CASE WHEN contains(name, 'counter') OR contains(name, 'desk') OR contains(name, 'till') THEN 'counter' END,
    CASE WHEN contains(name, 'toilet') OR contains(name, 'wc') THEN 'toilet' END], lambda x: x IS NOT NULL), ',') AS roles FROM n""")
def piece_roles(spark, sf_dir):
    """the roles of a piece by the words of its label."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.roles(_name()), ",").alias("roles"))


@query("resolved_subjects", """WITH a AS (SELECT o_orderkey AS q, o_custkey AS pinned, o_orderkey % 3 = 0 AS has_pin, CASE o_orderkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'small ring' WHEN 2 THEN 'gizmo blue' ELSE 'zz' END AS asked FROM orders), p AS (SELECT *, p_partkey AS k FROM part),
    m AS (SELECT a.asked, count(*) AS n, min(k) AS first FROM (SELECT DISTINCT asked FROM a) a JOIN p ON list_bool_and(list_transform(string_split(asked, ' '), lambda w: contains(lower(p_name), w))) GROUP BY 1)
    SELECT q, CASE WHEN has_pin AND k IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS n, CASE WHEN has_pin AND k IS NOT NULL THEN k ELSE first END AS first FROM a LEFT JOIN p ON k = pinned LEFT JOIN m USING (asked)""")
def resolved_subjects(spark, sf_dir):
    """a question's pinned piece if it has one that is there, else the pieces whose label has its words."""
    k = F.col("o_orderkey")
    asked = F.when(k % 4 == 0, "red").when(k % 4 == 1, "small ring").when(k % 4 == 2, "gizmo blue").otherwise("zz")
    q = table(spark, sf_dir, "orders").select(k.alias("q"), F.when(k % 3 == 0, F.col("o_custkey")).alias("pinned"), asked.alias("asked"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("name"))
    by_words = p.join(containment.all_words_in(q, p, "asked", "name"), "name").groupBy("asked").agg(F.count("*").alias("m"), F.min("k").alias("least"))
    both = q.join(p.select("k"), F.col("k") == F.col("pinned"), "left").join(by_words, "asked", "left")
    has = F.col("k").isNotNull()
    return both.select("q", F.when(has, 1).otherwise(F.coalesce("m", F.lit(0))).cast("long").alias("n"), F.when(has, F.col("k")).otherwise(F.col("least")).alias("first"))


@query("quantities_with_units", """WITH t AS (SELECT p_partkey AS k, 'width ' || p_size || ' cm, height ' || (p_size + 1) || '.5in and 3 apples, ' || p_partkey % 9 || ' ft away' AS text, p_size AS s FROM part)
    SELECT k, 3 AS n, round(s * 0.01::DOUBLE, 6) AS first, round((s + 1.5::DOUBLE) * 0.0254::DOUBLE, 6) AS second, round(k % 9 * 0.3048::DOUBLE, 6) AS third FROM t""")
def quantities_with_units(spark, sf_dir):
    """Numbers with their units, in metres."""
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("width "), s, F.lit(" cm, height "), s + 1, F.lit(".5in and 3 apples, "), k % 9, F.lit(" ft away"))
    q = table(spark, sf_dir, "part").select(k.alias("k"), T.quantities(text).alias("q"))
    return q.select("k", F.size("q").alias("n"), *[F.round(F.col("q")[i]["metres"], 6).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("filled_sentences", """SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 4 THEN n_name || ' is ' || (n_nationkey % 7) || ' long and ' || CASE WHEN n_regionkey > 1 THEN 'fits' ELSE 'does not fit' END || '.' END AS text FROM nation""")
def filled_sentences(spark, sf_dir):
    """A template's holes and choices; without a figure there is no sentence."""
    size = F.when(F.col("n_nationkey") % 5 != 4, F.col("n_nationkey") % 7)
    text = T.filled(F.lit("{name} is {size} long and {ok?fits|does not fit}."), {"name": F.col("n_name"), "size": size}, {"ok": F.col("n_regionkey") > 1})
    return table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))


@query("counts_in_words", """WITH i AS (SELECT p_partkey, p_size AS n FROM part) SELECT p_partkey, CASE WHEN n < 24 THEN n || CASE WHEN n = 1 THEN ' inch' ELSE ' inches' END WHEN n % 12 = 0 THEN n // 12 || ' feet' ELSE n // 12 || ' feet ' || n % 12 || CASE WHEN n % 12 = 1 THEN ' inch' ELSE ' inches' END END AS length,
    CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a and b' ELSE 'a, b and c' END AS things FROM i""")
def counts_in_words(spark, sf_dir):
    """Lengths and lists in words."""
    k = F.col("p_partkey") % 3
    things = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.feet_and_inches(F.col("p_size").cast("double")).alias("length"), T.listed(things).alias("things"))


@query("system_tables", "SELECT p_partkey FROM part WHERE p_name NOT LIKE 'red_w%'")
def system_tables(spark, sf_dir):
    """names that don't fit a pattern, in which _ stands for any character."""
    return table(spark, sf_dir, "part").filter(~F.col("p_name").like("red_w%")).select("p_partkey")


@query("text_times", """SELECT event_id, epoch_us(ts) // 1000000 AS seconds, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) // 1000 * 1000) / 60e6, 6) AS age_minutes, ts + INTERVAL 14 DAY < TIMESTAMP '2024-02-01' AS expired FROM events""")
def text_times(spark, sf_dir):
    """ISO 8601 text as times: seconds, age in minutes, and whether a fortnight has passed."""
    at = F.to_timestamp(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    now = F.lit("2024-02-01").cast("timestamp")
    e = table(spark, sf_dir, "events").select("event_id", at.alias("at"))
    return e.select("event_id", F.unix_seconds("at").alias("seconds"), F.round((F.unix_micros(now) - F.unix_micros("at")) / 60e6, 6).alias("age_minutes"), (F.col("at") + F.expr("interval 14 days") < now).alias("expired"))


@query("affine_sample", """WITH n AS (SELECT count(*) AS n FROM customer), m AS (SELECT n, (SELECT min(i) FROM range(7, 1000) t(i) WHERE gcd(i, n) = 1) AS m FROM n) SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT (i * m + 3) % n FROM m, range(20) t(i))""")
def affine_sample(spark, sf_dir):
    """Twenty customers without repeats; the multiplier follows from how many there are. The sample is the feature."""
    from math import gcd

    from plumbline.operators import seq

    c = table(spark, sf_dir, "customer")
    n = c.count()
    multiplier = next(i for i in range(7, n + 8) if gcd(i, n) == 1)
    return c.filter(F.col("c_custkey").isin(seq.sample_without_replacement(n, min(20, n), multiplier, 3))).select("c_custkey")
