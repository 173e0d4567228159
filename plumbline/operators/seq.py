"""Operators over ordered rows: islands, chains, transitions, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.tables import cut, sent


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], inside: Column) -> DataFrame:
    """Rows where `inside` holds, with island: maximal runs of such rows are numbered from 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    begin = (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")
    marked = df.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_begin", begin)
    return marked.withColumn("island", F.sum("_begin").over(w)).filter("_in").drop("_in", "_begin")


def chain_groups(df: DataFrame, keys: Sequence[str], value: str, tolerance: float, then: Sequence[str] = ()) -> DataFrame:
    """group_id: a new group wherever the gap between neighbouring values exceeds the tolerance."""
    w = W.partitionBy(*keys).orderBy(value, *then)
    gap = F.col(value) - F.lag(value).over(w)
    new = F.when(gap > tolerance, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("group_id", F.sum("_new").over(w)).drop("_new")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Cumulative sum of `value` in order."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(from_state, to_state, n, share): how often a state follows another, and its share of what follows."""
    w = W.partitionBy(*keys).orderBy(*order)
    pairs = df.withColumn("to_state", F.lead(state).over(w)).filter("to_state is not null")
    counted = pairs.groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    total = counted.groupBy("from_state").agg(F.sum("n").alias("total"))
    return counted.join(total, "from_state").select("from_state", "to_state", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def until_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], success: Column) -> DataFrame:
    """Each group's rows up to and including its first success; all of them without one."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.coalesce(success, F.lit(False)).cast("int")).over(w), F.lit(0))
    return df.withColumn("_done", before).filter("_done = 0").drop("_done")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each group, and its last."""
    w = W.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_next", F.lead(F.lit(1)).over(w))
    return placed.filter((F.col("_at") % n == 0) | F.col("_next").isNull()).drop("_at", "_next")


def evenly_spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """At most k rows of each group at places round-half-even(linspace(0, n - 1, k)), in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    if k == 1:
        return placed.filter("_at = 0").drop("_at", "_n")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1), 0).cast("int"))
    return placed.filter((F.col("_n") <= k) | F.array_contains(places, F.col("_at").cast("int"))).drop("_at", "_n")


def filled_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Nulls of `column` replaced by the last value before them."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def separations(runs: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """Runs with to_next: where the next one begins, less where they end."""
    w = W.partitionBy(*keys).orderBy(begin, end)
    return runs.withColumn("to_next", F.lead(begin).over(w) - F.col(end))


def stalls(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Rows with stalled (equal to the row before) and repeated (seen before in the group)."""
    w = W.partitionBy(*keys).orderBy(*order)
    what = F.struct(*same)
    stalled = F.coalesce(F.lag(what).over(w) == what, F.lit(False))
    seen = F.row_number().over(W.partitionBy(*keys, *same).orderBy(*order)) > 1
    return df.withColumn("stalled", stalled).withColumn("repeated", seen)


def sample_without_replacement(n: int, k: int, multiplier: int, offset: int) -> list[int]:
    """k distinct places among n: (i * multiplier + offset) mod n, for a multiplier prime to n."""
    from math import gcd

    if gcd(multiplier, n) != 1 or k > n:
        raise ValueError("the multiplier must be prime to n, and k at most n")
    return [(i * multiplier + offset) % n for i in range(k)]


def running_totals(df: DataFrame, keys: Sequence[str], cell: str, order: str, values: dict[str, str]) -> DataFrame:
    """`df` with the sum of each value over all rows up to and including its own, in the order of `cell`, then `order`.

    values: new names by column. Only rows of a cell are ordered in one task; what comes before a cell is summed from a
    row a cell. Cells must follow the order, and rows equal in `order` get one total.
    """
    before = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys, cell).agg(*[F.sum(c).alias(f"_{c}") for c in values])
    starts = sums.select(*keys, cell, *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in values])
    own = W.partitionBy(*keys, cell).orderBy(order)
    placed = df.join(starts, [*keys, cell])
    return placed.withColumns({name: F.col(f"_before_{c}") + F.sum(c).over(own) for c, name in values.items()}).drop(*[f"_before_{c}" for c in values])


def percentiles(df: DataFrame, group: str, value: str, qs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(group, q): exact percentiles of the values that aren't null, interpolated between neighbours, an array a group.

    A sketch of each group gives two values that a percentile lies between, however values lie. Those below are
    counted, and only those between are gathered, by value, and put in order. Should the sketch have been too far off
    for some rank, the next round looks wider.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    n, reach = len(qs), 3 / accuracy
    while True:
        ends = [q + side * reach for q in qs for side in (-1, 1)]
        sketch = F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, e))) for e in ends]), accuracy)
        inner = lambda i: F.lit(0.0 < ends[i] < 1.0)
        found = rows.groupBy("_g").agg(sketch.alias("_p"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_total"))
        edges = [F.when(inner(i), F.col("_p")[i]).otherwise(F.col("_max" if i % 2 else "_min")) for i in range(2 * n)]
        # A row a group: where groups are few, their values stay in their tasks.
        edges = sent(found.select(F.col("_g").alias("_of"), "_total", *[e.alias(f"_e{i}") for i, e in enumerate(edges)]))
        placed = rows.join(edges, F.col("_g").eqNullSafe(F.col("_of")))
        below = placed.groupBy("_g", "_total").agg(*[F.count_if(F.col("_v") < F.col(f"_e{2 * i}")).alias(f"_b{i}") for i in range(n)])
        which = F.array_compact(F.array(*[F.when((F.col("_v") >= F.col(f"_e{2 * i}")) & (F.col("_v") <= F.col(f"_e{2 * i + 1}")), F.lit(i)) for i in range(n)]))
        between = placed.select("_g", "_v", F.explode(which).alias("_i")).groupBy("_g", "_i", "_v").agg(F.count("*").alias("_n"))
        before = F.coalesce(*[F.when(F.col("_i") == i, F.col(f"_b{i}")) for i in range(n)])
        counts = between.join(sent(below.withColumnRenamed("_g", "_of")), F.col("_g").eqNullSafe(F.col("_of")))
        counts = counts.withColumn("_upto", before + F.sum("_n").over(W.partitionBy("_g", "_i").orderBy("_v")))
        told = []
        for i, q in enumerate(qs):
            at = F.lit(q) * (F.col("_total") - 1)
            has = lambda rank, i=i: (F.col("_i") == i) & (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            low, high = (F.max(F.when(has(r), F.col("_v"))) for r in (F.floor(at), F.ceil(at)))
            told.append(low + (high - low) * F.max(at - F.floor(at)))
        done = cut(counts.groupBy("_g").agg(F.array(*told).alias("q")).select(F.col("_g").alias(group), "q"))
        if reach >= 1 or done.filter(F.exists("q", lambda x: x.isNull())).isEmpty():
            return done
        reach *= 8


def covering(intervals: DataFrame, key: str, low: str, high: str, cell: float) -> DataFrame:
    """(key, n, overlap): how many other intervals (closed) each meets, and for how long in sum.

    No pairs are made. Intervals met are all but those that end before it begins or begin after it ends; the time in
    common is what all intervals cover up to its end less what they cover up to its beginning. Both are running totals
    over ends, by cells of `cell`.
    """
    marks = intervals.select(F.col(low).alias("at"), F.lit(1).alias("b"), F.lit(0).alias("e"), F.col(low).alias("sb"), F.lit(0.0).alias("se")).union(
        intervals.select(F.col(high), F.lit(0), F.lit(1), F.lit(0.0), F.col(high))
    )
    by = marks.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("b", "e", "sb", "se")]).withColumn("cell", F.floor(F.col("at") / cell))
    tot = running_totals(by, [], "cell", "at", {"b": "begun", "e": "ended", "sb": "sum_begun", "se": "sum_ended"})
    covered = F.col("at") * (F.col("begun") - F.col("ended")) - F.col("sum_begun") + F.col("sum_ended")
    tot = tot.select("at", "begun", (F.col("ended") - F.col("e")).alias("ended_before"), covered.alias("covered"))
    at = lambda c, s: tot.select(F.col("at").alias(c), *[F.col(x).alias(f"{x}_{s}") for x in ("begun", "ended_before", "covered")])
    both = intervals.select(key, low, high).join(at(low, "l"), low).join(at(high, "h"), high)
    return both.select(key, (F.col("begun_h") - F.col("ended_before_l") - 1).alias("n"), (F.col("covered_h") - F.col("covered_l") - (F.col(high) - F.col(low))).alias("overlap"))


def in_order(df: DataFrame, key: str, order: Sequence[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """What `step(state, row)` gives for the rows of each key in order, None for nothing; it may change the state.

    For operators whose next decision needs the one before. Many keys share a task, a key's rows stream through one,
    and only its state is held. Rows with a null key are one key's.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = None if pd.isna(getattr(row, key)) else getattr(row, key)
                if state is None or now != at:
                    at, state = now, start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
