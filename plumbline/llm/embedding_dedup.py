"""Near-duplicate embeddings by sorted projection passes.

Each pass orders vectors by a key, the concatenated bits of random hyperplanes, and compares each with the `window`
that follow it, by cosine in double precision. A run of equal keys longer than a window is compared whole beside
them, in tiles if it is large. Verified pairs are united across passes. Vectors of equal keys always meet, and a pair
at the threshold shares a bit with a chance that depends on its angle alone, so with the number of passes that
follows from the number of bits it is missed with a chance of `miss` at the most, however the other vectors lie;
neighbours of unequal keys are found besides. The number of bits follows from the number of vectors, so that a
quarter of a window shares a key where vectors are evenly spread. Windows end with the vectors that share all but the
last `LAST` bits, or all bits where more than `CROWD` vectors do that, so a task's rows are bounded. Work in a long run
of crowded vectors grows with its square. Copies of a vector enter once.

Links are then counted exactly inside each component. Vectors within half the threshold's angle of the
component's mean direction are linked with each other for certain, by the triangle inequality, and are only
counted; the others are compared with all members, in tiles. So a group of copies costs a row a member.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
have component_id = vec_id and are kept. Only vectors of equal length are compared. Rows that repeat a vec_id
and its vector are one vector and get the same result; a null vec_id links with nothing. Extra columns are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, cut, parts

WINDOW = 256
TILE = 1024
#: Rows whose windows a task compares at once; bits at the end of a key that windows reach across, and rows up to which they do.
STEP, LAST, CROWD = 256, 6, 65_536
#: Large buckets up to which their sizes are broadcast.
MOST_LARGE = 100_000


def bits_for(n: int, window: int) -> int:
    """Bits after which evenly spread vectors leave about a quarter of `window` with one key."""
    return min(62, max(0, math.ceil(math.log2(max(1, n) * 4 / window))))


def passes_for(n: int, threshold: float, window: int, miss: float) -> int:
    """Passes until a pair at the threshold is missed with a chance of `miss`."""
    agree = 1 - math.acos(threshold) / math.pi
    near = agree ** bits_for(n, window)
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(near, 0.999))))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pass_links(vectors: DataFrame, bits: int, passes: int, threshold: float, window: int) -> DataFrame:
    """Links (a, b) that unite what all passes verify."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def keyed(with_vectors: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, same in batch.groupby(batch["embedding"].map(len)):
                    x = _unit(same["embedding"])
                    for p in range(passes):
                        planes = np.random.default_rng([p, dim]).standard_normal((dim, bits))
                        key = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                        made = {"run": p * 65_536 + dim, "key": key.astype(np.int64)}
                        yield pd.DataFrame(made | {c: same[c] for c in ("vec_id", "embedding")} if with_vectors else made)

        return vectors.mapInPandas(run, "run int, key long" + f", vec_id long, embedding {kind}" * with_vectors)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            places = rows[place].to_numpy(np.int64)
            starts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist()]
            rest = rows.iloc[starts[-1] :]
            found = [link for s, e in zip(starts, starts[1:], strict=False) for link in _compared(rows.iloc[s:e], threshold, window)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if rest is not None:
            yield pd.DataFrame(_compared(rest, threshold, window), columns=["a", "b"], dtype="int64")

    sizes = cut(keyed(False).groupBy("run", "key").count())
    front = F.shiftright("key", LAST)
    small = lambda df: df if df.count() > MOST_LARGE else F.broadcast(df)
    long = small(cut(sizes.filter(F.col("count") > window)))
    crowds = sizes.groupBy("run", front.alias("front")).agg(F.sum("count").alias("crowd")).filter(F.col("crowd") > CROWD)
    known = keyed(True).withColumn("front", front).join(long, ["run", "key"], "left").join(small(cut(crowds)), ["run", "front"], "left")
    # A tile of a long run meets every tile of it; other rows go where their windows lie, in the order of keys.
    spread = (
        known.withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("vec_id"), F.coalesce("tiles", F.lit(1))).cast("int"))
        .withColumn("far", F.explode(F.expr("sequence(0, coalesce(tiles, 1) - 1)")))
        .select(
            "run",
            F.when(F.col("tiles").isNotNull() | F.col("crowd").isNotNull(), F.col("key")).otherwise(F.col("front")).alias("block"),
            F.when(F.col("tiles").isNotNull(), F.least("own", "far")).when(F.col("crowd").isNotNull(), F.lit(-2)).otherwise(F.lit(-1)).alias("t1"),
            F.when(F.col("tiles").isNotNull(), F.greatest("own", "far")).otherwise(F.lit(-1)).alias("t2"),
            "key", "vec_id", "embedding",
        )
    )
    place = ["run", "block", "t1", "t2"]
    dealt = spread.repartition(max(parts(vectors.sparkSession), passes), *place).sortWithinPartitions(*place, "key", "vec_id")
    return dealt.mapInPandas(meet, "a long, b long").distinct()


def _compared(rows: pd.DataFrame, threshold: float, window: int) -> list[tuple[int, int]]:
    """Links of a tile pair, or of the windows of rows in the order of keys."""
    if rows["t1"].iloc[0] >= 0:
        return _joined(rows, threshold)
    return [link for s in range(0, len(rows), STEP) for link in _joined(rows.iloc[s : s + STEP + window], threshold)]


def _joined(rows: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links that unite the rows within the threshold of each other: from the first row of each group to the others."""
    if len(rows) < 2:
        return []
    x, ids = _unit(rows["embedding"]), rows["vec_id"].to_numpy(np.int64)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    left, out = near.any(axis=1), []
    while left.any():
        first = int(left.argmax())
        left[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            out += [(min(ids[first], i), max(ids[first], i)) for i in ids[front].tolist() if i != ids[first]]
    return out


def _centres(members: DataFrame) -> DataFrame:
    """component_id, dim and centre: the sum of a component's unit vectors."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (c, dim), rows in batch.groupby(["component_id", "dim"]):
                yield pd.DataFrame({"component_id": [c], "dim": [dim], "part": [_unit(rows["embedding"]).sum(0)]})

    partial = members.mapInPandas(sums, "component_id long, dim int, part array<double>")
    return (
        partial.select("component_id", "dim", F.posexplode("part"))
        .groupBy("component_id", "dim", "pos")
        .agg(F.sum("col").alias("s"))
        .groupBy("component_id", "dim")
        .agg(F.expr("transform(array_sort(collect_list(struct(pos, s))), x -> x.s)").alias("centre"))
    )


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """vec_id, fp and n_links of every member (vec_id, fp, embedding, dim, component_id), exactly."""
    half = math.acos(threshold) / 2 - 1e-7

    def angled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("dim"):
                c = np.stack(rows["centre"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(c, axis=1)
                cos = np.einsum("ij,ij->i", _unit(rows["embedding"]), c / np.maximum(size, 1e-300)[:, None])
                core = (np.arccos(np.clip(cos, -1, 1)) <= half) & (size > 1e-9)
                yield rows.drop(columns="centre").assign(core=core)

    schema = f"vec_id long, fp long, embedding {members.schema['embedding'].dataType.simpleString()}, dim int, component_id long"
    with_core = cut(
        # Written, so that a large component is split in the join.
        members.join(cut(_centres(members)), ["component_id", "dim"])
        .select("vec_id", "fp", "embedding", "dim", "component_id", "centre")
        .mapInPandas(angled, schema + ", core boolean")
    )
    sizes = cut(
        with_core.groupBy("component_id", "dim").agg(
            F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_outer")
        )
    )
    both = with_core.join(sizes, ["component_id", "dim"])
    inner = both.filter("core").select("vec_id", "fp", (F.col("n_core") - 1).alias("n_links"))
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    # An outer tile meets every outer tile and every core tile of its component.
    spread = (
        both.filter("n_outer > 0")
        .withColumns({"outer_tiles": tiles("n_outer"), "core_tiles": tiles("n_core")})
        .withColumn("own", F.pmod(F.xxhash64("vec_id", "fp"), F.when(F.col("core"), F.col("core_tiles")).otherwise(F.col("outer_tiles"))).cast("int"))
        .withColumn("far", F.explode(F.expr("sequence(0, outer_tiles - 1)")))
        .select(
            "component_id", "dim", "vec_id", "fp", "embedding", "core",
            F.when(F.col("core"), F.col("far")).otherwise(F.least("own", "far")).alias("t1"),
            F.when(F.col("core"), -1 - F.col("own")).otherwise(F.greatest("own", "far")).alias("t2"),
            "own", "core_tiles",
        )
    )
    with_cores = spread.filter("not core and own = far and core_tiles > 0").withColumn(
        "t2", F.explode(F.expr("transform(sequence(1, core_tiles), i -> -i)"))
    )
    with_cores = with_cores.withColumn("t1", F.col("own"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(rows["embedding"])
        near = x @ x.T >= threshold
        core, own, t1, t2 = (rows[c].to_numpy() for c in ("core", "own", "t1", "t2"))
        if t2[0] < 0:
            near &= core[:, None] != core[None, :]
        elif t1[0] != t2[0]:
            near &= own[:, None] != own[None, :]
        else:
            np.fill_diagonal(near, False)
        return pd.DataFrame({"vec_id": rows["vec_id"], "fp": rows["fp"], "n_links": near.sum(1)})

    met = (
        spread.union(with_cores.select(spread.columns))
        .groupBy("component_id", "dim", "t1", "t2")
        .applyInPandas(meet, "vec_id long, fp long, n_links long")
    )
    return inner.union(met).groupBy("vec_id", "fp").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = WINDOW, miss: float = 0.002) -> DataFrame:
    """Every row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    # Doubles stay doubles; anything else is at most a float.
    kind = "array<double>" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "array<float>"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast(kind).alias("embedding"),
        F.xxhash64("embedding").alias("fp"),
    )
    sound = F.expr(
        """vec_id is not null and size(embedding) > 0
           and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as float))
           and exists(embedding, x -> x <> 0)"""
    )
    distinct = cut(
        rows.filter(sound).groupBy("vec_id", "fp").agg(F.first("embedding").alias("embedding"))
    )
    shared = cut(distinct.groupBy("fp", "embedding").agg(F.min("vec_id").alias("first")))
    n = shared.count()
    found = _pass_links(shared.select(F.col("first").alias("vec_id"), "embedding"), bits_for(n, window), passes_for(n, threshold, window, miss), threshold, window)
    copies = distinct.join(shared, ["fp", "embedding"]).filter("first <> vec_id").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    links = cut(found.union(copies))
    named = cut(components(links).select(F.col("node").alias("vec_id"), "component_id"))
    members = distinct.join(named, "vec_id").withColumn("dim", F.size("embedding"))
    counted = _counted(cut(members), threshold)
    found = counted.join(named, "vec_id").select(F.col("vec_id").alias("v"), F.col("fp").alias("f"), "n_links", "component_id")
    return rows.select("vec_id", "fp").join(found, (F.col("vec_id") == F.col("v")) & (F.col("fp") == F.col("f")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, min(c) = r.vec_id AS kept
FROM r LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) AS k ON k.vec_id = r.vec_id GROUP BY r.vec_id
"""
