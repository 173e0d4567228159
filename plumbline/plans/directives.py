"""Layout directives as data: a corpus in JSON, the scenes that trigger them, and violations that a change brings.

A directive is {id, verified, trigger: {typology, entities}, inspection_queries: [..], constraints: [{check, piece}]}.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.containment import held_in
from plumbline.tables import cut, sent

DIRECTIVE = """struct<id: string, verified: boolean, trigger: struct<typology: string, entities: array<string>>,
    inspection_queries: array<string>, constraints: array<struct<`check`: string, piece: string>>>"""


def parse_directives(docs: DataFrame, preview: bool = False) -> DataFrame:
    """(id, verified, typology, entities, inspection_queries, constraints) of documents (doc), one directive each.

    Unverified directives are dropped, or those that don't say, unless it is a preview. A document that is no directive
    or has no id is left out.
    """
    read = docs.select(F.from_json("doc", DIRECTIVE).alias("d")).select("d.id", F.coalesce("d.verified", F.lit(False)).alias("verified"), "d.trigger.typology", "d.trigger.entities", "d.inspection_queries", "d.constraints")
    return read.filter(F.col("id").isNotNull() & (F.lit(preview) | F.col("verified")))


def read_directives(spark: SparkSession, path: str, preview: bool = False) -> DataFrame:
    """The directives of files of one JSON document a line."""
    return parse_directives(spark.read.text(path).select(F.col("value").alias("doc")), preview)


def inspections(directives: DataFrame) -> DataFrame:
    """(id, place, query): each directive's inspection queries in order."""
    return directives.select("id", F.posexplode("inspection_queries").alias("place", "query"))


def triggered(directives: DataFrame, scenes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(scene, id): directives whose typology holds a scene's (scene, typology), or the other way round, and one of whose entities a token (scene, token) of it holds.

    Case doesn't matter. A directive without a typology fits every scene's, and one without entities needs none. Texts
    are compared once each, however many scenes have them. What fits a kind or a token is sent to the scenes' tasks, if it is
    few rows: kinds and tokens may be few, and a join by shuffles would bring all their scenes to a task each.
    """
    asked = directives.select("id", F.lower("typology").alias("asked"), F.transform("entities", F.lower).alias("entities"))
    kinds = scenes.select(F.lower("typology").alias("kind")).distinct()
    either = held_in(asked, kinds, "asked", "kind").union(held_in(kinds, asked, "kind", "asked").select("asked", "kind")).distinct()
    fits = asked.filter("asked <> ''").join(either, "asked").select("id", "kind")
    any_kind = asked.filter("coalesce(asked, '') = ''").select("id").crossJoin(F.broadcast(kinds))
    by_kind = cut(fits.union(any_kind))
    words = tokens.select("scene", F.lower("token").alias("token"))
    wanted = asked.select("id", F.explode("entities").alias("entity"))
    found = held_in(wanted, words, "entity", "token")
    free = asked.filter("coalesce(size(entities), 0) = 0").select("id").distinct()
    by_both = by_kind.join(free, "id", "left_anti").join(wanted.join(found, "entity").select("id", "token").distinct(), "id").select("kind", "token", "id")
    placed = scenes.select("scene", F.lower("typology").alias("kind"))
    needing = placed.join(words.hint("merge"), "scene").join(sent(by_both), ["kind", "token"]).select("scene", "id").distinct()
    return needing.union(placed.join(sent(by_kind.join(free, "id", "left_semi")), "kind").select("scene", "id").distinct())


def brought(candidate: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of the candidate whose keys the base doesn't have; null keys are equal to each other."""
    known = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys]).distinct()
    return candidate.join(known, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], "left_anti")
