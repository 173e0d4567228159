"""Greedy choices over all rows, in rounds: what one row after the other would choose, chosen by many rows at once.

A row decides as soon as no undecided row before it is near enough to matter; all such rows decide together. Nearness
is found by cells, so a round is a few equi-joins and no group is a task. The number of rounds is the longest chain of
rows that wait for each other: short where order and place have nothing to do with each other, as long as the chain
where rows are ordered along a line. Keys are distinct within a group. A row with a null or non-finite coordinate is
near no other row. Joins are by shuffles: rows of a small file may be many in cells and pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.operators.spatial import within
from plumbline.tables import cut


def _sound(at: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in at:
        # 0 * x is null, or NaN, for what is no number.
        found = found & F.coalesce(F.col(c) * 0 == F.lit(0.0), F.lit(False)) & ~F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(True))
    return found


class _Grid:
    """Cells whose rows are at most `radius` apart, and how many cells away a row within `radius` may lie."""

    def __init__(self, by: Sequence[str], at: Sequence[str], radius: float):
        self.at, self.side = list(at), radius * (1 + 1e-9) / math.sqrt(len(at))
        self.cells = [f"_c{i}" for i in range(len(at))]
        self.place = [*by, *self.cells]
        self.reach = math.ceil(math.sqrt(len(at)))

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.floor(F.col(a) / self.side) for c, a in zip(self.cells, self.at, strict=True)})

    def around(self, df: DataFrame) -> DataFrame:
        for c in self.cells:
            df = df.withColumn(c, F.explode(F.sequence(F.col(c) - self.reach, F.col(c) + self.reach)))
        return df

    def distance(self, other: str) -> Column:
        return F.sqrt(sum(((F.col(c) - F.col(f"{other}{c}")) ** 2 for c in self.at), F.lit(0.0)))


def _winners(left: DataFrame, grid: _Grid, key: str, near: Column, sided: bool) -> DataFrame:
    """Rows of `left` before which no row of another side (_side) in reach comes in _order; `near` compares with _o_ columns.

    Only what comes first in its cell can win, and rows of its side before the first one of another. These few are then
    compared with the rows of the cells around them.
    """
    if sided:
        first = left.groupBy(*grid.place, "_side").agg(F.min("_order").alias("_first"))
        two = first.withColumn("_n", F.row_number().over(Window.partitionBy(*grid.place).orderBy("_first"))).filter("_n <= 2")
        ends = two.groupBy(*grid.place).agg(F.min_by("_side", "_first").alias("_own"), F.count("*").alias("_sides"), F.max("_first").alias("_end"))
        able = left.join(ends.hint("merge"), grid.place).filter((F.col("_side") == F.col("_own")) & ((F.col("_sides") == 1) | (F.col("_order") < F.col("_end")))).select(left.columns)
    else:
        able = left.groupBy(*grid.place).agg(F.min_by(F.struct(*left.columns), "_order").alias("_row")).select("_row.*")
    able = cut(able)
    rival = left.select(*grid.place, *[F.col(c).alias(f"_o_{c}") for c in [*grid.at, "_side", "_order"]])
    meets = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in grid.place]
    beaten = grid.around(able).alias("l").join(rival.hint("merge").alias("r"), [*meets, near, F.col("_side") != F.col("_o__side"), F.col("_o__order") < F.col("_order")], "left_semi")
    who = [*[c for c in grid.place if c not in grid.cells], key]
    return cut(able.join(beaten.select(*who).distinct().hint("merge"), who, "left_anti"))


#: Groups of at most so many rows are chosen from in one task, in memory bounded by its square.
MOST_TOGETHER = 2048


def _by_size(points: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of at most MOST_TOGETHER rows, and of larger ones; rows of a null group are a group."""
    large = cut(points.groupBy(*by).agg(F.count("*").alias("_m")).filter(F.col("_m") > MOST_TOGETHER).select(*[F.col(c).alias(f"_of_{c}") for c in by]))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return points.join(large.hint("merge"), same, "left_anti"), points.join(large.hint("merge"), same, "left_semi")


def _apart(table: pa.Table, at: Sequence[str]) -> np.ndarray:
    """Distances between all rows of a bounded group."""
    return np.sqrt(sum((np.subtract.outer(v, v) ** 2 for v in (table[c].to_numpy().astype(float) for c in at)), 0.0))


def _chosen_together(points: DataFrame, by: Sequence[str], order: str, key: str, name: str, choose) -> DataFrame:
    """`points` with `name`: the key of the row that `choose` gives for each row of a group in `order`, a group a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return table.append_column(name, table[key].take(pa.array(choose(table))))

    kind = StructType([*points.schema.fields, StructField(name, points.schema[key].dataType)])
    return points.groupBy(*by).applyInArrow(run, kind)


def _apart_in_order(table: pa.Table, at: Sequence[str], radius: float, touching: bool) -> np.ndarray:
    """For each row in order, the place of the first kept row of another side that is near it, or its own."""
    distance, side = _apart(table, at), pd.factorize(table["_side"].to_pandas())[0]
    near = (distance <= radius) if touching else (distance < radius)
    near &= np.not_equal.outer(side, side)
    kept, out = np.zeros(len(side), bool), np.arange(len(side))
    for i in range(len(side)):
        over = near[i, :i] & kept[:i]
        if over.any():
            out[i] = over.argmax()
        else:
            kept[i] = True
    return out


def first_apart(rows: DataFrame, by: Sequence[str], key: str, at: Sequence[str], radius: float, order: Sequence[Column] = (), side: str | None = None, touching: bool = True) -> DataFrame:
    """`rows` (by, key, at) with kept_as: in `order`, then by key, a row is kept unless a kept one is near it.

    Near is within `radius`, at the radius itself only if `touching`, and, where a `side` is named, of another side. A
    row that isn't kept names the first kept one that is near it, a kept one itself. Rounds are for groups of more than
    MOST_TOGETHER rows; smaller ones are chosen from within a task each.
    """
    grid = _Grid(by, at, radius)
    columns = list(dict.fromkeys([*by, key, *at, *([side] if side else [])]))
    whole = rows.select(*columns, F.struct(*order, F.col(key)).alias("_order"), F.col(side or key).alias("_side"))
    # Of no side, a row is near none of another.
    alone = ~_sound(at) | F.col(side or key).isNull()
    odd = rows.filter(alone).select(*columns, F.col(key).alias("kept_as"))
    whole = whole.filter(~alone)
    if by:
        few, whole = _by_size(whole, by)
        placed = few.select(*columns, "_side", F.row_number().over(Window.partitionBy(*by).orderBy("_order")).alias("_at"))
        odd = _chosen_together(placed, by, "_at", key, "kept_as", lambda table: _apart_in_order(table, at, radius, touching)).select(*columns, "kept_as").union(odd)
    left = all_rows = cut(grid.placed(whole))
    kept = None
    near = (grid.distance("_o_") <= radius) if touching else (grid.distance("_o_") < radius)
    other = lambda df: df.select(*grid.place, *[F.col(c).alias(f"_o_{c}") for c in [*at, key, "_side", "_order"]])
    while not left.isEmpty():
        won = _winners(left, grid, key, near, side is not None)
        kept = won if kept is None else kept.union(won)
        covers = grid.around(other(won))
        meets = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in grid.place]
        rest = left.join(won.select(*by, key).hint("merge"), [*by, key], "left_anti").select(left.columns)
        left = cut(rest.alias("l").join(covers.hint("merge").alias("r"), [*meets, near & (F.col("_side") != F.col("_o__side"))], "left_anti"))
    if kept is None:
        return odd
    kept = cut(kept)
    gone = all_rows.join(kept.select(*by, key).hint("merge"), [*by, key], "left_anti")
    named = gone.join(grid.around(other(kept)).hint("merge"), grid.place).filter(near & (F.col("_side") != F.col("_o__side")))
    named = named.groupBy(*columns).agg(F.min_by(f"_o_{key}", "_o__order").alias("kept_as"))
    return kept.select(*columns, F.col(key).alias("kept_as")).union(named).union(odd)


def _densest_together(points: DataFrame, by: Sequence[str], key: str, at: Sequence[str], radius: float) -> DataFrame:
    """`densest` of groups of at most MOST_TOGETHER rows, one after the other in a task."""

    def choose(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        near = np.sqrt(sum((np.subtract.outer(v, v) ** 2 for v in (pdf[c].to_numpy(float) for c in at)), 0.0)) <= radius
        left, count, found = np.ones(len(pdf), bool), near.sum(1), []
        while left.any():
            best = int(np.where(left, count, -1).argmax())
            found.append((best, int(count[best])))
            covered = near[best] & left
            count = count - near[:, covered].sum(1)
            left &= ~covered
        chosen = pd.DataFrame({c: pd.Series([v] * len(found), dtype=object) for c, v in zip(by, group, strict=True)})
        return chosen.assign(**{key: pdf[key].to_numpy()[[i for i, _ in found]], "n": [n for _, n in found]})

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    return points.select(*by, key, *at).groupBy(*by).applyInPandas(choose, ", ".join([*[f"`{c}` {kinds[c]}" for c in (*by, key)], "n long"]))


def densest(rows: DataFrame, by: Sequence[str], key: str, at: Sequence[str], radius: float) -> DataFrame:
    """(by, key, n) of centres: again and again the row with most uncovered rows within `radius` (the smallest key on ties), which covers them.

    A row that is best within twice the radius is chosen before anything changes its count, so all such rows are
    chosen together; the counts of those that stay lose what was covered around them. n counts the centre itself.
    Rounds are for groups of more than MOST_TOGETHER rows; smaller ones are chosen from within a task each.
    """
    wide = _Grid(by, at, 2 * radius)
    rows = rows.select(*by, key, *at)
    name = F.struct(*by, F.col(key))
    points = rows.filter(_sound(at)).withColumns({"_all": F.lit(0), "_id": name})
    count = lambda a, b: within(a, b, "_id", at, radius, group="_by", itself=True).groupBy("_id").agg(F.count("*").alias("_m"))
    points = points.withColumn("_by", F.struct(*by) if by else F.lit(0))
    together = None
    if by:
        few, points = _by_size(points, by)
        together = _densest_together(few, by, key, at, radius)
    left = cut(points.join(count(points, points).hint("merge"), "_id").withColumnRenamed("_m", "_n"))
    found = rows.filter(~_sound(at)).select(*by, key, F.lit(1).cast("long").alias("n"))
    if together is not None:
        found = found.union(together)
    while not left.isEmpty():
        ordered = wide.placed(left).withColumns({"_order": F.struct(-F.col("_n"), F.col(key)), "_side": F.col(key)})
        won = _winners(ordered, wide, key, wide.distance("_o_") <= 2 * radius, False)
        found = found.union(won.select(*by, key, F.col("_n").alias("n")))
        covered = cut(within(left, won, "_id", at, radius, group="_by", itself=True).select("_id").distinct())
        gone = left.join(covered.hint("merge"), "_id")
        stay = left.join(covered.hint("merge"), "_id", "left_anti")
        lost = count(stay, gone)
        left = cut(stay.join(lost.hint("merge"), "_id", "left").withColumn("_n", F.col("_n") - F.coalesce("_m", F.lit(0))).drop("_m"))
    return found


def _links_in_order(table: pa.Table, at: Sequence[str], tolerance: float) -> np.ndarray:
    """For each row in order, the place of the founder of its cluster."""
    far = ~(_apart(table, at) <= tolerance)
    founders: list[int] = []
    own = np.zeros(len(far), np.int64)
    for i in range(len(far)):
        free = np.bincount(own[:i][far[i, :i]], minlength=len(founders)) == 0
        own[i] = free.argmax() if free.any() else len(founders)
        if own[i] == len(founders):
            founders.append(i)
    return np.array(founders, np.int64)[own]


def complete_link(rows: DataFrame, by: Sequence[str], key: str, at: Sequence[str], tolerance: float) -> DataFrame:
    """`rows` (by, key, at) with cluster: in order of keys, a row joins the first cluster all of whose members are within the tolerance, else founds one.

    A cluster is named by its founder; the first one is that of the smallest founder. Rows at one place are one row: a
    later one always joins the cluster of the first. A row joins its first compatible cluster once no undecided row
    before it could be kept apart from it there, or could found an earlier cluster that takes it; it founds one once it
    is compatible with none and no undecided row before it is within the tolerance. Clusters only become less
    compatible, so what is decided early is what the sequence decides. Pairs within twice the tolerance are held: work
    grows with the places that near each other. Rounds are for groups of more than MOST_TOGETHER rows; smaller ones are
    linked within a task each.
    """
    columns = [*by, key, *at]
    rows = rows.select(columns)
    sound = rows.filter(_sound(at))
    odd = rows.filter(~_sound(at)).withColumn("cluster", F.col(key))
    if by:
        few, sound = _by_size(sound, by)
        odd = _chosen_together(few, by, key, key, "cluster", lambda table: _links_in_order(table, at, tolerance)).union(odd)
    places = cut(sound.groupBy(*by, *at).agg(F.min(key).alias(key)))
    id_of = F.struct(*by, F.col(key))
    points = places.select(id_of.alias("i"), *at, (F.struct(*by) if by else F.lit(0)).alias("_by"))
    pairs = within(points, points, "i", at, 2 * tolerance, group="_by").withColumnRenamed("other", "j").select("i", "j", (F.col("distance") <= tolerance).alias("near"))
    # What a row may still meet: other rows, and the cluster of each that has decided.
    left, pairs = cut(points.select("i")), cut(pairs.withColumn("cluster", F.lit(None).cast(points.schema["i"].dataType)))
    decided = None
    while not left.isEmpty():
        sizes = decided.groupBy("cluster").agg(F.count("*").alias("size")) if decided is not None else None
        compatible = None
        if sizes is not None:
            met = pairs.filter("cluster is not null and near").groupBy("i", "cluster").agg(F.count("*").alias("met")).join(sizes.hint("merge"), "cluster")
            compatible = cut(met.filter("met = size").select("i", "cluster"))
            first = left.join(compatible.groupBy("i").agg(F.min("cluster").alias("to")).hint("merge"), "i", "left")
        else:
            first = left.withColumn("to", F.lit(None).cast(points.schema["i"].dataType))
        first = cut(first)
        before = pairs.filter("cluster is null and j < i").join(first.hint("merge"), "i")
        founds = before.filter("near and (to is null or j < to)").select("i")
        if compatible is not None:
            rival = compatible.select(F.col("i").alias("j"), F.col("cluster").alias("to"))
            founds = founds.union(before.filter("not near and to is not null").join(rival.hint("merge"), ["j", "to"], "left_semi").select("i"))
        now = cut(first.join(founds.distinct().hint("merge"), "i", "left_anti").select("i", F.coalesce("to", "i").alias("cluster")))
        decided = now if decided is None else decided.union(now)
        left = cut(left.join(now.hint("merge"), "i", "left_anti"))
        told = now.select(F.col("i").alias("j"), F.col("cluster").alias("its"))
        pairs = cut(pairs.join(now.select("i").hint("merge"), "i", "left_anti").join(told.hint("merge"), "j", "left").select("i", "j", "near", F.coalesce("cluster", "its").alias("cluster")))
    if decided is None:
        return odd
    named = decided.select(*[F.col(f"i.{c}").alias(c) for c in by], F.col(f"i.{key}").alias("_first"), F.col(f"cluster.{key}").alias("cluster"))
    whole = sound.join(places.withColumnRenamed(key, "_first").hint("merge"), [*by, *at]).join(named.hint("merge"), [*by, "_first"])
    return whole.select(*columns, "cluster").union(odd)
