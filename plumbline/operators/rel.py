"""Relational operators: latest rows, reconciliation, division, upserts, severity, queues, trees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import spatial
from plumbline.tables import cut


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order`. End `order` with a unique column, so that ties have one answer."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` with no partner: an anti-join, which a null key on the right can't empty."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def having_all(df: DataFrame, key: str, item: str, wanted: Sequence) -> DataFrame:
    """Relational division: keys that occur with every one of the wanted items."""
    found = df.filter(F.col(item).isin(list(wanted))).groupBy(key).agg(F.count_distinct(item).alias("_n"))
    return found.filter(F.col("_n") == len(set(wanted))).select(key)


def reconcile(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of counted sides: one row per key that any side has, with has_<side> for each."""
    marked = [df.select(key).distinct().withColumn(f"has_{name}", F.lit(True)) for name, df in sides.items()]
    both = reduce(lambda a, b: a.join(b, key, "full"), marked)
    return both.select(key, *[F.coalesce(f"has_{name}", F.lit(False)).alias(f"has_{name}") for name in sides])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], guard: Column | None = None) -> DataFrame:
    """`old` with rows of `new` in place of those with their key, and its other rows added.

    guard: a condition on the old row (columns by name) under which it may be replaced. version, if `old` has it,
    is raised by one when a row is replaced.
    """
    may = old.withColumn("_may", F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))
    locked = may.filter("not _may")
    fresh = new.join(locked.select(*keys), list(keys), "left_anti")
    if "version" in old.columns:
        before = old.select(*keys, F.col("version").alias("_version"))
        fresh = fresh.join(before, list(keys), "left").withColumn("version", F.coalesce(F.col("_version") + 1, "version"))
    return old.join(fresh.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` with those rows of `new` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def cascade_delete(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows that belong to the deleted keys."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def most_severe(df: DataFrame, keys: Sequence[str], satisfied: Column, severity: Column, then: Sequence[Column]) -> DataFrame:
    """One row per key: unsatisfied before satisfied, then the most severe, then the first in `then`."""
    return latest_by(df, keys, [satisfied.cast("int").asc(), severity.desc(), *then])


def claim(jobs: DataFrame, lanes: Sequence[str], per_lane: int, order: Sequence[Column]) -> DataFrame:
    """The queued jobs that each lane would claim next, with their place."""
    place = F.row_number().over(W.partitionBy(*lanes).orderBy(*order))
    return jobs.withColumn("place", place).filter(F.col("place") <= per_lane)


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """(root, node, depth) for every node below the roots in edges (parent, child), cycles walked once.

    A level is one join; levels end when a join finds nothing new, and a tree deeper than max_depth is an error.
    """
    level = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"))
    found = level
    for depth in range(1, max_depth + 2):
        level = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth"))
        level = cut(level.join(found.select("root", "node"), ["root", "node"], "left_anti").distinct())
        if level.isEmpty():
            return found
        found = found.union(level)
    raise RuntimeError(f"a tree is deeper than {max_depth} levels")


def ancestors(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, ancestor, depth) for every child of edges (parent, child): the parent at depth 1, cycles walked once."""
    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    below = descendants(up, edges.select(F.col("child").alias("root")).distinct(), max_depth)
    return below.filter("depth > 0").select(F.col("root").alias("node"), F.col("node").alias("ancestor"), "depth")


def cyclic(parents: DataFrame) -> DataFrame:
    """Nodes (node) on a cycle of (child, parent), a parent each or null, and those below one.

    Pointers double: after each round they reach twice as far, and nodes whose pointer has left the tree drop out.
    A round in which none does leaves only those that never will.
    """
    left = cut(parents.filter("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("to")))
    n = left.count()
    while n:
        step = left.select(F.col("node").alias("to"), F.col("to").alias("next"))
        left = cut(left.join(step, "to").select("node", F.col("next").alias("to")))
        before, n = n, left.count()
        if n == before:
            break
    return left.select("node")


def unmatched(a: DataFrame, b: DataFrame, key: str, kind: str, at: Sequence[str], near: float, value: str, within_value: float) -> DataFrame:
    """Rows of `a` that no row of `b` equals: of the same kind, within `near` of its place, its value within a tolerance.

    A row without a place, or without a value, equals only rows without one. Placed rows meet by grid cells, those of
    one kind, place and value once, however many they are; so do rows without a place.
    """
    fits = (F.col(value).isNull() & F.col(f"_{value}").isNull()) | F.coalesce(F.abs(F.col(value) - F.col(f"_{value}")) <= within_value, F.lit(False))
    what = F.struct(kind, *at, value)
    placed_once = lambda df: df.filter(F.col(at[0]).isNotNull()).select(kind, *at, value).distinct().select(kind, *at, what.alias("_what"))
    placed = spatial.within(placed_once(a), placed_once(b), "_what", at, near, group=kind, itself=True)
    met_at = placed.select("_what", F.col(f"_what.{value}").alias(value), F.col(f"other.{value}").alias(f"_{value}")).filter(fits).select("_what").distinct()
    hits = a.select(key, what.alias("_what")).join(met_at.hint("merge"), "_what", "left_semi").select(key)
    # Without a place, rows of a kind meet by cells of their value alone.
    cell = lambda c: F.floor(F.col(c) / within_value)
    alone = a.filter(F.col(at[0]).isNull()).select(kind, value).distinct().select(kind, value, F.explode(F.when(F.col(value).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(cell(value) - 1, cell(value) + 1))).alias("_cell"))
    there = b.filter(F.col(at[0]).isNull()).select(F.col(kind).alias("_kind"), F.col(value).alias(f"_{value}"), cell(value).alias("_there")).distinct()
    met = alone.join(there.hint("merge"), (alone[kind] == there["_kind"]) & alone["_cell"].eqNullSafe(there["_there"])).filter(fits).select(F.col(kind).alias("_kind"), F.col(value).alias("_like")).distinct()
    unplaced = a.filter(F.col(at[0]).isNull()).select(key, kind, value)
    like = unplaced.join(met.hint("merge"), (F.col(kind) == F.col("_kind")) & F.col(value).eqNullSafe(F.col("_like")), "left_semi").select(key)
    return a.join(hits.union(like).distinct().hint("merge"), key, "left_anti")


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose parent isn't a node."""
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, kind): added, removed or changed between two states."""
    b, a = before.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), after.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    kind = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_a")), "changed")
    return b.join(a, key, "full").withColumn("kind", kind).filter("kind is not null").select(key, "kind")


def fingerprint(df: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """sha256 per key over its rows as text, in sorted order: the same whatever the order they came in.

    A key's rows are gathered in one place: for keys of few rows. `digest` takes any number.
    """
    joined = F.array_join(F.array_sort(F.collect_list(row)), "\n")
    return df.groupBy(*keys).agg(F.sha2(joined, 256).alias("fingerprint"))


def digest(df: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """(keys, rows, fingerprint): a digest of each key's rows as text, the same whatever their order.

    Rows are hashed one by one, and two parts of the hashes summed, so tasks send sums and no key's rows meet. Null rows
    count as the text ''.
    """
    own = F.sha2(F.coalesce(row, F.lit("")), 256)
    part = lambda at: F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = df.groupBy(*keys).agg(F.count("*").alias("rows"), part(1).alias("_a"), part(16).alias("_b"))
    return sums.select(*keys, "rows", F.sha2(F.concat_ws("/", "rows", F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("fingerprint"))
