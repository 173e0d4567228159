"""The query of answers judged against the scans that they are about."""

from pyspark.sql import functions as F

from plumbline.plans import verified
from plumbline.registry import query
from plumbline.tables import table

_NOUNS = ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod")


@query("judged_answers", f"""WITH q AS (SELECT p_partkey AS id, p_partkey // 5 AS scene, p_size AS z, p_partkey % 6 AS r, {list(_NOUNS)}[p_partkey * 7 % 8 + 1] AS noun, p_size % 9 AS d FROM part),
    h AS (SELECT DISTINCT p_partkey // 5 AS scene, string_split(p_name, ' ')[2] AS kind FROM part), m AS (SELECT p_partkey // 5 AS scene, p_size * s AS n FROM part, (SELECT unnest([1.0, 0.01, 0.001, 0.0254, 0.3048])::DOUBLE AS s)),
    c AS (SELECT p_partkey // 5 AS scene, avg(CASE WHEN p_size > 12 THEN 1.0 ELSE 0 END) AS share FROM part GROUP BY 1),
    a AS (SELECT *, CASE r WHEN 0 THEN z WHEN 1 THEN z * 25.4 WHEN 2 THEN 777.5 WHEN 4 THEN d + 0.25 END::DOUBLE AS v, [d + 0.25, 2]::DOUBLE[] AS asked FROM q),
    k AS (SELECT a.*, (scene, noun) IN (SELECT scene, kind FROM h) AS there, v IS NULL OR v = 0 OR len(list_filter(asked, lambda n: len(list_filter([1.0, 0.01, 0.001, 0.0254, 0.3048], lambda s: abs(v - n * s::DOUBLE) <= greatest(abs(v) * 0.02::DOUBLE, 1e-6))) > 0)) > 0
      OR EXISTS (SELECT 1 FROM m WHERE m.scene = a.scene AND abs(a.v - n) <= greatest(abs(a.v) * 0.02::DOUBLE, 1e-6)) AS fine FROM a)
    SELECT id, CASE WHEN share < 0.6 THEN 'not measured enough' WHEN r = 3 AND NOT there THEN 'absence as zero' WHEN r <> 3 AND NOT there THEN 'not in the scan' WHEN NOT fine THEN 'figures from nowhere' END AS refused FROM k JOIN c USING (scene)""")
def judged_answers(spark, sf_dir):
    """Q10: answers about rooms of five pieces: what they name, what they count as none, and their figures."""
    k, z = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumn("scene", F.floor(k / 5))
    noun, r = F.element_at(F.array(*[F.lit(n) for n in _NOUNS]), (k * 7 % 8 + 1).cast("int")), k % 6
    wide = lambda v: F.concat(F.lit("The "), noun, F.lit(" is "), v.cast("string"), F.lit(" wide."))
    text = (
        F.when(r == 0, wide(z)).when(r == 1, wide(F.round(z * 25.4, 1))).when(r == 2, wide(F.lit(777.5))).when(r == 3, F.concat(F.lit("There is no "), noun, F.lit(".")))
        .when(r == 4, wide(z % 9 + 0.25)).otherwise(F.concat(F.lit("I see a "), noun))
    )
    asked = F.concat(F.lit("is it "), (z % 9 + 0.25).cast("string"), F.lit(" or two"))
    answers = p.select(k.alias("id"), "scene", text.alias("text"), asked.alias("asked"))
    kinds = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in _NOUNS])).alias("kind"))
    held = p.select("scene", F.split("p_name", " ")[1].alias("kind"))
    seen = p.groupBy("scene").agg(F.avg((z > 12).cast("double")).alias("share"))
    return verified.verdicts(answers, kinds, held, p.select("scene", z.cast("double").alias("value")), seen, 0.6)
