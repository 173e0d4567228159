"""The catalogue of primitives: what a caller may name, with which arguments; refusals are rows, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, what it gives, and the arguments that it needs: fixed values.
PRIMITIVES = [
    ("height_of", "length", ["piece"]), ("size_of", "length", ["piece", "axis"]), ("distance_between", "length", ["piece", "other"]), ("floor_area_of", "area", ["piece"]),
    ("clearance_above", "length", ["piece"]), ("text_on", "texts", ["piece"]), ("everything_in_the_room", "pieces", []), ("objects_on", "pieces", ["piece"]),
    ("objects_inside", "pieces", ["piece"]), ("everything_carried_by", "pieces", ["piece"]), ("what_carries", "pieces", ["piece"]), ("find_objects", "pieces", ["words"]),
]


def vocabulary(spark: SparkSession) -> DataFrame:
    """name, returns and arguments of every primitive."""
    return spark.createDataFrame(PRIMITIVES, "name string, returns string, arguments array<string>")


def judged_calls(calls: DataFrame) -> DataFrame:
    """`calls` (name, arguments as JSON text) with refused: null for a call that may run, else why not.

    Arguments must be an object that has what the primitive needs, none of it null, and nothing else.
    """
    known = F.broadcast(vocabulary(calls.sparkSession).select("name", F.col("arguments").alias("needs")))  # a fixed list
    given = F.from_json("arguments", "map<string, string>")
    named = F.array_sort(F.map_keys(F.map_filter(given, lambda _, v: v.isNotNull())))
    refused = (
        F.when(F.col("needs").isNull(), F.concat(F.lit("unknown name "), F.coalesce("name", F.lit("null"))))
        .when(given.isNull(), "arguments are no object")
        .when(F.size(F.array_except("needs", named)) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(F.array_except("needs", named)), ", ")))
        .when(F.size(F.array_except(F.map_keys(given), "needs")) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(F.array_except(F.map_keys(given), "needs")), ", ")))
    )
    return calls.join(known, "name", "left").withColumn("refused", refused).drop("needs")
