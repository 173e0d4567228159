"""Evaluation: precision and recall, Wilson bounds, best-of, gates, and leak-free splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_recall(rows: DataFrame, keys: Sequence[str], predicted: Column, true: Column) -> DataFrame:
    """tp, fp, fn, precision and recall of each group; null where there is nothing to divide by."""
    by = rows.groupBy(*keys).agg(F.count_if(predicted & true).alias("tp"), F.count_if(predicted & ~true).alias("fp"), F.count_if(~predicted & true).alias("fn"))
    share = lambda other: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), 4)
    return by.withColumns({"precision": share("fp"), "recall": share("fn")})


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share, rounded to four places; null for an empty group."""
    n = F.when(total > 0, total)
    p = successes / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.round((centre - spread) / scale, 4), F.round((centre + spread) / scale, 4)


def best_and_all(rows: DataFrame, by: str, group: str, success: Column) -> DataFrame:
    """Share of groups where any attempt, and where every attempt, succeeded."""
    groups = rows.groupBy(by, group).agg(F.bool_or(success).alias("any"), F.bool_and(success).alias("all"))
    return groups.groupBy(by).agg(F.round(F.avg(F.col("any").cast("int")), 4).alias("best_of"), F.round(F.avg(F.col("all").cast("int")), 4).alias("all_of"))


def gate(better: Column, safe: Column, known: Column) -> Column:
    """True, false, or null while the measurement behind the gate is unknown."""
    return F.when(better & F.coalesce(safe, F.lit(False)), True).when(known.isNull(), None).otherwise(False)


def leak_free_split(rows: DataFrame, key: str, pieces: str, held_out: Column) -> DataFrame:
    """(key, split): held_out, dropped where a row shares a piece with a held-out one, else train."""
    marked = rows.withColumn("_held", held_out)
    taken = marked.filter("_held").select(F.explode(pieces).alias("piece")).distinct()
    shares = marked.filter("not _held").select(key, F.explode(pieces).alias("piece")).join(taken, "piece", "left_semi").select(key).distinct()
    return marked.join(shares.withColumn("_shares", F.lit(True)), key, "left").select(
        key, F.when(F.col("_held"), "held_out").when(F.col("_shares"), "dropped").otherwise("train").alias("split")
    )


def arm_summary(attempts: DataFrame, arm: str) -> DataFrame:
    """One row an arm of attempts (case, parsed, accepted, resolved, cleared, reward, disruption, usable, seconds, ceiling).

    Rates are over all attempts, conditional means over the accepted ones, and nulls are left out of means. By case: any
    attempt accepted, every one, and accepted cases over those that a search could have (ceiling).
    """
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(f"{c}_rate")
    if_accepted = lambda c: F.round(F.avg(F.when(F.col("accepted"), F.col(c))), 4).alias(f"{c}_if_accepted")
    rows = attempts.groupBy(arm).agg(
        F.count("*").alias("attempts"), *map(rate, ("parsed", "accepted", "resolved", "cleared")), F.round(F.avg("reward"), 4).alias("reward"),
        *map(if_accepted, ("reward", "disruption", "usable")), F.count("usable").alias("measured"), F.count_if(F.col("usable").isNull()).alias("missing"),
        F.min("usable").alias("least_usable"), F.count_if(F.col("usable") < 1).alias("below_one"), F.max("seconds").alias("slowest"), F.count_if(~F.col("parsed")).alias("unparsed"),
    )
    by_case = attempts.groupBy(arm, "case").agg(F.bool_or("accepted").alias("any"), F.bool_and("accepted").alias("all"), F.bool_or("ceiling").alias("could"))
    cases = by_case.groupBy(arm).agg(
        F.count("*").alias("cases"), F.round(F.avg(F.col("any").cast("int")), 4).alias("best_of"), F.round(F.avg(F.col("all").cast("int")), 4).alias("all_of"),
        F.round(F.try_divide(F.count_if(F.col("any") & F.col("could")), F.count_if("could")), 4).alias("of_ceiling"),
    )
    return rows.join(cases, arm)


def soft_vote(votes: DataFrame, key: str, agree) -> DataFrame:
    """(key, name, support, share): the name with the most confidence in names that agree with it, then most of its own.

    votes: key, words (an array), name, weight. Weights of equal names are summed first, so names meet, not votes.
    share: the support over all weight. `agree` is a function of two arrays of words.
    """
    by = votes.groupBy(key, "name").agg(F.sum("weight").alias("own"), F.first("words").alias("words"))
    other = by.select(key, F.col("words").alias("_words"), F.col("own").alias("_own"))
    met = by.join(other, key).filter(agree(F.col("words"), F.col("_words"))).groupBy(key, "name", "own").agg(F.sum("_own").alias("support"))
    best = met.groupBy(key).agg(F.min_by(F.struct("name", "support"), F.struct(-F.col("support"), -F.col("own"), "name")).alias("b"))
    total = by.groupBy(key).agg(F.sum("own").alias("total"))
    return best.join(total, key).select(key, "b.name", "b.support", F.round(F.col("b.support") / F.col("total"), 4).alias("share"))


def fullest_bin(values: DataFrame, key: str, value: str, width: float, share: float) -> DataFrame:
    """(key, bin, n, share) of each key's fullest bin (the lowest on ties), if it holds at least `share` of the values."""
    bins = values.groupBy(key, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.groupBy(key).agg(F.sum("n").alias("total"), F.min_by(F.struct("bin", "n"), F.struct(-F.col("n"), "bin")).alias("b"))
    return top.filter(F.col("b.n") >= share * F.col("total")).select(key, "b.bin", "b.n", F.round(F.col("b.n") / F.col("total"), 4).alias("share"))


def campaign(outcomes: DataFrame, task: str, profile: str, kinds: Sequence[str]) -> DataFrame:
    """A row a task and profile: how often each outcome came, and a digest that doesn't depend on the rows' order."""
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    return outcomes.groupBy(task, profile).agg(*counts, F.sum(F.crc32(F.concat_ws("|", "id", "outcome").cast("binary"))).alias("digest"))
