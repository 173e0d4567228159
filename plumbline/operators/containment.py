"""Which strings hold which others, by an index of runs of letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.tables import cut


def held_in(needles: DataFrame, texts: DataFrame, needle: str, text: str, gram: int = 3) -> DataFrame:
    """Distinct (needle, text) of distinct strings where the first is a substring of the second.

    An index holds the texts of each run of `gram` letters; a needle asks for its rarest run alone, and what it finds
    is confirmed. Needles shorter than that ask runs of their own length. Null and empty needles are held in nothing.
    """
    wanted = needles.select(needle).filter(F.length(needle) > 0).distinct()
    runs = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(F.col(c), i, k)))
    wanted = wanted.withColumn("_k", F.least(F.length(needle), F.lit(gram)))
    # Only the lengths of run that some needle asks for are indexed.
    sizes = wanted.select("_k").distinct()
    held = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    index = held.crossJoin(F.broadcast(sizes)).filter(F.length(text) >= F.col("_k")).select(text, F.explode(runs(text, F.col("_k"))).alias("_run"))
    index = cut(index)
    common = index.groupBy("_run").agg(F.count("*").alias("_n"))
    asked = wanted.select(needle, F.explode(runs(needle, F.col("_k"))).alias("_run")).join(common, "_run")
    rarest = asked.groupBy(needle).agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"), F.count("*").alias("_found"))
    return rarest.join(index, "_run").filter(F.contains(text, needle)).select(needle, text)


def all_words_in(asked: DataFrame, texts: DataFrame, words: str, text: str) -> DataFrame:
    """Distinct (words, text) of distinct strings where every word, between single spaces, of the first is in the second."""
    split = asked.select(words).distinct().withColumn("_word", F.explode(F.array_distinct(F.filter(F.split(words, " "), lambda w: w != ""))))
    needed = split.groupBy(words).agg(F.count("*").alias("_needed"))
    found = split.join(held_in(split, texts, "_word", text), "_word").groupBy(words, text).agg(F.count("*").alias("_has"))
    return found.join(needed, words).filter("_has = _needed").select(words, text)
