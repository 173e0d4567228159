"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles gives m registers: truncated minima of exponential variables on an
exponential scale of base b. Registers of a union are maxima, so they merge, and two sets agree in a register
about as often as they are similar. Bands of registers bring documents together; the counts of larger, smaller
and equal registers estimate the similarity jointly by maximum likelihood, and full sets confirm every link.

Copies with equal sets are one class throughout. Inside a bucket, members are compared with one leader, drawn
anew for each bucket; only where verified links leave a bucket in several components are the members outside
its leader's component compared with all members of other components: pair by pair in small buckets, and in
larger ones tile against tile, where a task compares wide sketches, then full sets, and gives only links. So a bucket of linked copies costs a comparison a member, and no pair in a bucket stays untested unless
links join it anyway. With 64 registers in bands of 4, a pair at similarity 0.85 shares no bucket with a chance
below 1e-5; the wide sketch of 512 registers loses it with a chance of about 1e-4.

Defined results: a document without words or text has an empty set, component_id = doc_id, and no links. Rows
that repeat a doc_id are one document, linked if any of its rows link. A null doc_id links with nothing, has a
null component_id and is kept. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, cut, parts, texts
from plumbline.llm.words import hashes, mix, shingles, words

#: Registers, registers a band, base and rate of the sketch, and its largest register value.
M, BAND, BASE, RATE, TOP = 64, 4, 1.02, 20.0, 4095
#: Registers of the wide sketch that documents in shared buckets get.
WIDE = 512
#: Estimates so far below the least similarity aren't verified: about four standard errors of the wide sketch.
SLACK = 0.06
#: Members of a bucket up to which its open pairs are listed; rows of a tile beyond that.
FEW, TILE = 32, 768
#: Members that one task run compares with one document.
CHUNK = 256

_SEEDS = mix(np.arange(1, WIDE + 1, dtype=np.uint64)) | np.uint64(1)


def registers(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """SetSketch registers, a row of m for each non-empty set of 64-bit hashes."""
    out = np.empty((len(sets), m), np.uint16)
    done = 0
    while done < len(sets):
        end, size = done, 0
        while end < len(sets) and (not size or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[done:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[done : end - 1]], dtype=np.int64)))
        low = np.empty((end - done, m), np.uint64)
        for j in range(m):
            low[:, j] = np.minimum.reduceat(flat * _SEEDS[j], starts)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64).clip(max=745) / RATE
        out[done:end] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP)
        done = end
    return out


def likely_similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two rows of registers and the sizes of their sets."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, 101)[None, :]

    def p(x):
        return -np.log1p(-np.maximum(x, 1e-9) * (BASE - 1) / BASE) / np.log(BASE)

    possible = (j <= np.minimum(u / v, v / u) + 1e-9) * 1.0
    up, down = p(u - v * j), p(v - u * j)
    like = more * np.log(up) + less * np.log(down) + (ra.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return j[0][np.argmax(np.where(possible > 0, like, -np.inf), axis=1)]


def sketches(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (of the set) and sketch (M little-endian uint16) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(hashes(words(t)), k) for t in batch["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = registers([sets[i] for i in full]).astype("<u2") if full else []
            sketch = [None] * len(sets)
            for i, r in zip(full, rows, strict=True):
                sketch[i] = r.tobytes()
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_shingles": [len(s) for s in sets],
                    "h1": [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                    "h2": [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                    "sketch": sketch,
                }
            )

    return texts(docs).mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """rep, elements (the sorted set), wide (sketch) and n_shingles of the documents in `needed` (rep)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(hashes(words(t)), k) for t in batch["text"]]
            ids = batch["doc_id"].to_numpy()
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                sets = [sets[i] for i in full]
                wide = registers(sets, WIDE).astype("<u2")
                yield pd.DataFrame(
                    {"rep": ids[full], "elements": [s.astype("<u8").tobytes() for s in sets], "wide": [w.tobytes() for w in wide], "n_shingles": [len(s) for s in sets]}
                )

    some = texts(docs).join(needed.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    return some.mapInPandas(run, "rep long, elements binary, wide binary, n_shingles long")


def _estimated(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that the registers don't rule out."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("wide").alias(f"s_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024]
                ra, rb = (np.frombuffer(b"".join(part[c]), "<u2").reshape(-1, WIDE) for c in ("s_a", "s_b"))
                na, nb = (part[c].to_numpy(float) for c in ("n_a", "n_b"))
                yield part.loc[likely_similarity(ra, rb, na, nb) >= least, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A document with many partners is compared in chunks of them, each with a copy of its set.
    """
    n = parts(pairs.sparkSession)
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = cut(pairs.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), "b"))
    of = lambda x: sets.select(F.col("rep").alias(x), "elements")
    rows = dealt.select("a", "chunk").distinct().join(of("a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "elements")
    rows = rows.union(dealt.join(of("b"), "b").select("a", "chunk", "b", "elements"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, firsts = None, []
        for batch in batches:
            found = []
            for a, chunk, b, raw in zip(batch["a"], batch["chunk"], batch["b"], batch["elements"], strict=True):
                if (a, chunk) != at:
                    at, firsts = (a, chunk), []
                s = np.frombuffer(raw, "<u8")
                if pd.isna(b):
                    firsts.append(s)
                    continue
                for f in firsts:
                    if 100 * min(len(f), len(s)) < percent * max(len(f), len(s)):
                        continue
                    both = len(np.intersect1d(f, s, assume_unique=True))
                    if 100 * both >= percent * (len(f) + len(s) - both):
                        found.append((int(a), int(b)))
                        break
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (
        rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b")).mapInPandas(run, "a long, b long").distinct()
    )


def _listed(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a small bucket in different components, one of them outside the leader's.

    placed: bucket, n (its members), rep, c (component), c_leader, for buckets with several components.
    """
    few = placed.filter(F.col("n") <= FEW)
    other = few.select("bucket", F.col("rep").alias("other"), F.col("c").alias("c_other"))
    pairs = few.filter("c <> c_leader").join(other, "bucket").filter("c <> c_other and (c_other = c_leader or rep < other)")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _tiled(placed: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Verified links (a, b) between components of large buckets.

    Large buckets with the same most common component are one family. Members outside that component are compared
    with all of the family, a tile of at most about TILE rows against another in a task.
    """
    many = placed.filter(F.col("n") > FEW)
    common = many.groupBy("bucket", "c").count().groupBy("bucket").agg(F.max_by("c", F.struct("count", "c")).alias("family"))
    members = cut(many.join(common, "bucket").select("family", "rep", "c").distinct().withColumn("inner", F.col("c") == F.col("family")))
    sizes = members.groupBy("family").agg(
        F.ceil(F.count_if("inner") / TILE).cast("int").alias("inner_tiles"), F.ceil(F.count_if(~F.col("inner")) / TILE).cast("int").alias("outer_tiles")
    )
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("inner_tiles")).otherwise(F.col("outer_tiles"))).cast("int")
    # Tile pairs (t1, t2): outer with outer, t1 <= t2; outer t1 with inner t2, counted from -1 down.
    meets = F.expr(
        """if(inner, transform(sequence(0, outer_tiles - 1), i -> struct(i as t1, -1 - own as t2)),
               concat(transform(sequence(0, outer_tiles - 1), i -> struct(least(i, own) as t1, greatest(i, own) as t2)),
                      if(inner_tiles = 0, array(), transform(sequence(1, inner_tiles), i -> struct(own as t1, -i as t2)))))"""
    )
    tiled = (
        members.join(sizes.filter("outer_tiles > 0"), "family")
        .withColumn("own", own)
        .withColumn("meet", F.explode(meets))
        .join(sets.select("rep", "wide", "elements"), "rep")
        .select("family", "meet.t1", "meet.t2", "rep", "c", "inner", "wide", "elements")
    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.frombuffer(b"".join(rows["wide"]), "<u2").reshape(-1, WIDE).astype(np.uint8).T.copy()
        ids, c, inner, elements = (rows[x].to_numpy() for x in ("rep", "c", "inner", "elements"))
        outer = np.flatnonzero(~inner)
        same = np.zeros((len(outer), len(ids)), np.uint16)
        for register in r:
            same += register[outer][:, None] == register[None, :]
        near = (same >= least * WIDE) & (c[outer][:, None] != c[None, :])
        if rows["t2"].iloc[0] < 0:
            near &= inner[None, :]
        found = []
        for i, others in enumerate(near):
            s = np.frombuffer(elements[outer[i]], "<u8") if others.any() else None
            for j in np.flatnonzero(others):
                f = np.frombuffer(elements[j], "<u8")
                both = len(np.intersect1d(f, s, assume_unique=True))
                if 100 * both >= percent * (len(f) + len(s) - both):
                    found.append((min(ids[outer[i]], ids[j]), max(ids[outer[i]], ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return tiled.groupBy("family", "t1", "t2").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """Every row of `docs`: doc_id, n_shingles, component_id, kept."""
    least = percent / 100 - SLACK
    made = cut(sketches(docs, k))
    reps = cut(
        made.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    )
    width = 2 * BAND
    bands = cut(
        reps.select(
            "rep",
            F.explode(F.expr(f"transform(sequence(0, {M // BAND - 1}), i -> xxhash64(i, substring(sketch, i * {width} + 1, {width})))")).alias("bucket"),
        ).distinct()
    )
    leaders = (
        bands.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bucket", "rep"), "rep")).alias("first"))
        .filter("n > 1")
        .select("bucket", "n", F.col("first.rep").alias("leader"))
    )
    crowded = cut(bands.join(leaders, "bucket"))
    sets = cut(full_sets(docs, crowded.select("rep").distinct(), k))
    pairs = crowded.filter("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    links = cut(verified(cut(_estimated(pairs, sets, least)), sets, percent))
    named = components(links)
    of = lambda x: named.select(F.col("node").alias(x), F.col("component_id").alias(f"c_{x}"))
    placed = cut(
        crowded.join(of("rep"), "rep", "left")
        .join(of("leader"), "leader", "left")
        .select("bucket", "n", "rep", F.coalesce("c_rep", "rep").alias("c"), F.coalesce("c_leader", "leader").alias("c_leader"))
    )
    still_open = placed.groupBy("bucket").agg(F.count_if(F.col("c") != F.col("c_leader")).alias("outside")).filter("outside > 0")
    rest = cut(placed.join(still_open.select("bucket"), "bucket", "left_semi"))
    more = verified(cut(_estimated(_listed(rest), sets, least)), sets, percent).union(_tiled(rest, sets, least, percent))
    named = components(links.union(cut(more)))
    classes = reps.join(of("rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("c_rep", "rep").alias("class_id"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return (
        made.select("doc_id", "n_shingles", "h1", "h2")
        .join(classes, ["h1", "h2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""
