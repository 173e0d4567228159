"""Answers against the scan that they are about: what it holds, what it measured, and whether it saw enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.answers import SCALES, SHARE, figures, stated

#: What says that there is none of a thing: fixed words.
NONE = ("no", "zero", "0")


def verdicts(answers: DataFrame, kinds: DataFrame, held: DataFrame, measured: DataFrame, seen: DataFrame, enough: float) -> DataFrame:
    """(id, refused) of answers (id, scene, text, asked): null, or the first reason to refuse one.

    not measured enough: less than `enough` of the scene (scene, share) was seen, or nobody knows; absence as zero: the
    answer says that there is none of a kind (kind) that the scan (scene, kind) didn't find, as if it had looked; not in
    the scan: it names another kind that isn't there; figures from nowhere: one of its figures is neither stated in the
    question nor measured in the scene (scene, value), at any scale. Ids are distinct; a null text says nothing.

    Words and figures are rows, and meet kinds by word and measures by scene and size, in steps of their tolerance.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}.]+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.rtrim(w, F.lit(".")))
    said = answers.select("id", "scene", F.posexplode(plain).alias("at", "kind"), plain.alias("_words"))
    named = said.join(kinds.select("kind").distinct(), "kind")
    before = F.when(F.col("at") > 0, F.get("_words", F.col("at") - 1))
    strange = named.withColumn("none", F.coalesce(before.isin(*NONE), F.lit(False))).join(held.select("scene", "kind").distinct(), ["scene", "kind"], "left_anti")
    strange = strange.groupBy("id").agg(F.bool_or("none").alias("zero"), F.bool_or(~F.col("none")).alias("stranger"))

    # Equal to within a share: logarithms to within a step, so they lie in the same cell or the next.
    step = -2 * F.log(F.lit(1 - SHARE))
    cell = lambda v: F.floor(F.log(v) / step)
    own = answers.select("id", "scene", F.explode(F.array_distinct(figures(F.col("text")))).alias("value"), stated(F.col("asked")).alias("_asked"))
    near = lambda v, n: F.abs(v - n) <= F.greatest(F.abs(v) * SHARE, F.lit(1e-6))
    # A zero is no measure: whether it may be said is a matter of what is there.
    told = own.filter((F.col("value") > 0) & ~F.exists("_asked", lambda n: F.exists(F.array(*[F.lit(s) for s in SCALES]), lambda s: near(F.col("value"), n * s))))
    known = measured.filter("value > 0").select("scene", F.explode(F.array(*[F.col("value") * s for s in SCALES])).alias("n")).distinct()
    known = known.withColumn("cell", F.explode(F.array(cell(F.col("n")) - 1, cell(F.col("n")), cell(F.col("n")) + 1)))
    found = told.withColumn("cell", cell(F.col("value"))).join(known, ["scene", "cell"]).filter(near(F.col("value"), F.col("n"))).select("id", "value").distinct()
    invented = told.join(found, ["id", "value"], "left_anti").select("id").distinct().withColumn("invented", F.lit(True))

    all_of = answers.select("id", "scene").join(seen.select("scene", "share"), "scene", "left").join(strange, "id", "left").join(invented, "id", "left")
    refused = (
        F.when(~F.coalesce(F.col("share") >= enough, F.lit(False)), "not measured enough").when(F.col("zero"), "absence as zero")
        .when(F.col("stranger"), "not in the scan").when(F.col("invented"), "figures from nowhere")
    )
    return all_of.select("id", refused.alias("refused"))
