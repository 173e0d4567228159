"""Queries of layout directives."""

from pyspark.sql import functions as F

from plumbline.plans import directives
from plumbline.registry import query
from plumbline.tables import table

#: Nouns and customers' segments that the directives of the query name in part.
_NOUNS, _SEGMENTS = ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod"), ("household", "machinery", "building", "furniture", "automobile")


def corpus(spark, sf_dir):
    """A directive for each nation, as JSON: part of a segment's name, or more than it, and parts of two nouns."""
    n = F.col("n_nationkey")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (at % len(names) + 1).cast("int"))
    segment = pick(_SEGMENTS, n)
    typology = F.when(n % 3 == 0, F.upper(F.substring(segment, 2, 5))).when(n % 3 == 1, F.concat(F.lit("the "), segment, F.lit(" wing")))
    entities = F.array(F.substring(pick(_NOUNS, n), 1, 3), F.substring(pick(_NOUNS, n * 3 + 1), 2, 2))
    doc = F.struct(
        F.col("n_name").alias("id"), (n % 4 != 2).alias("verified"), F.struct(typology.alias("typology"), F.when(n % 7 != 5, entities).alias("entities")).alias("trigger"),
        F.array(F.concat(F.lit("where is the "), pick(_NOUNS, n)), F.lit("how wide is it")).alias("inspection_queries"),
    )
    return table(spark, sf_dir, "nation").select(F.to_json(doc).alias("doc"))


_DIRECTIVES = f"""d AS (SELECT n_name AS id, n_nationkey AS n, {list(_SEGMENTS)}[n_nationkey % 5 + 1] AS seg, {list(_NOUNS)}[n_nationkey % 8 + 1] AS n1, {list(_NOUNS)}[(n_nationkey * 3 + 1) % 8 + 1] AS n2 FROM nation WHERE n_nationkey % 4 <> 2),
    t AS (SELECT id, n, CASE n % 3 WHEN 0 THEN substr(seg, 2, 5) WHEN 1 THEN 'the ' || seg || ' wing' END AS typology, [substr(n1, 1, 3), substr(n2, 2, 2)] AS entities, n1 FROM d)"""


@query("trigger_join", f"""WITH {_DIRECTIVES}, s AS (SELECT o_orderkey, lower(c_mktsegment) AS kind FROM orders JOIN customer ON c_custkey = o_custkey),
    w AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT o_orderkey AS scene, id FROM s JOIN t ON typology IS NULL OR contains(kind, typology) OR contains(typology, kind)
    WHERE n % 7 = 5 OR EXISTS (SELECT 1 FROM w WHERE l_orderkey = o_orderkey AND (contains(p_name, entities[1]) OR contains(p_name, entities[2])))""")
def trigger_join(spark, sf_dir):
    """The directives that an order's segment and parts trigger."""
    scenes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").hint("merge"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("scene"), F.col("c_mktsegment").alias("typology"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("token"))
    tokens = table(spark, sf_dir, "lineitem").join(parts.hint("merge"), "l_partkey").select(F.col("l_orderkey").alias("scene"), "token")
    return directives.triggered(directives.parse_directives(corpus(spark, sf_dir)), scenes, tokens)


@query("inspection_queries", f"""WITH {_DIRECTIVES} SELECT id, unnest([0, 1]) AS place, unnest(['where is the ' || n1, 'how wide is it']) AS query FROM t""")
def inspection_queries(spark, sf_dir):
    """The inspection queries of verified directives."""
    return directives.inspections(directives.parse_directives(corpus(spark, sf_dir)))


@query("brought_violations", """SELECT l_orderkey, l_linenumber, l_returnflag AS rule, l_partkey AS piece, nullif(l_suppkey % 10, 0) AS other FROM lineitem c WHERE l_linenumber > 3
    AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber <= 3 AND b.l_returnflag = c.l_returnflag AND b.l_partkey = c.l_partkey AND nullif(b.l_suppkey % 10, 0) IS NOT DISTINCT FROM nullif(c.l_suppkey % 10, 0))""")
def brought_violations(spark, sf_dir):
    """Violations whose rule, piece and other piece, which may be none, the state before doesn't have."""
    s = F.col("l_suppkey") % 10
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("rule"), F.col("l_partkey").alias("piece"), F.when(s != 0, s).alias("other"))
    return directives.brought(rows.filter("l_linenumber > 3"), rows.filter("l_linenumber <= 3"), ["rule", "piece", "other"])
