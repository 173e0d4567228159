"""Exact top-k by inner product of integer vectors, by MaxScore over sharded postings.

Rows are dealt to shards. A shard has a posting list for each term, that is each place of a vector: the rows, in order
of their ids, whose component there isn't zero, with the least and the greatest component of each range of rows. A
query's term adds at most its weight times one of these, or nothing. In each range terms are ordered by that bound; the
longest tail whose bounds together can't reach the k-th best score so far is not essential: a row found in no essential
list can't enter. Essential postings are traversed; the others are probed for those rows alone that are still
competitive, and rows leave as soon as what is left can't lift them. Rows come in order of their ids, so later ones
must beat the k-th score, not equal it. Shards give their own best k, which are merged.

Queries are read in blocks, postings lie in tasks of one shard and one block: a task holds a shard's postings and one
batch of queries, whatever the number of rows or queries.

Defined results: components of vectors of unequal length are zero where they lack. Vectors that are null or hold null
components take no part, nor do null ids; an empty vector scores 0. Rows that repeat an id and its vector are one row;
an id with several vectors is several rows, none of which is a candidate of a query of that id. Scores, and sums on the
way to them, must fit a long: else an error is raised. Extra columns are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, parts

#: Rows of a shard, rows of a range of it, and queries of a block: neither changes a result.
SHARD, RANGE, BLOCK = 32_768, 4_096, 16_384


class Postings:
    """The posting lists of one shard, from vectors in order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], range_rows: int):
        self.ids = ids
        self.ranges = [_Range(ids[s : s + range_rows], vectors[s : s + range_rows]) for s in range(0, len(ids), range_rows)]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k rows of other ids, best first, smaller ids first among equals."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for one in self.ranges:
            at, found = one.competitive(query, int(scores[-1]) if len(ids) == k else None)
            other = one.ids[at] != query_id
            ids, scores = np.concatenate([ids, one.ids[at][other]]), np.concatenate([scores, found[other]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


class _Range:
    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids, n = ids, len(ids)
        sizes = np.array([len(v) for v in vectors])
        flat = np.concatenate(vectors) if n else np.empty(0, np.int64)
        rows = np.repeat(np.arange(n), sizes)
        terms = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = flat != 0
        order = np.lexsort((rows[held], terms[held]))
        rows, terms, values = rows[held][order], terms[held][order], flat[held][order]
        self.terms, starts = np.unique(terms, return_index=True)
        self.rows = np.split(rows, starts[1:]) if len(starts) else []
        self.values = np.split(values, starts[1:]) if len(starts) else []
        # A row that lacks a term adds nothing to it, so bounds include zero unless the list is full.
        full = np.array([len(r) == n for r in self.rows], bool)
        low = np.array([v.min() for v in self.values], np.int64)
        high = np.array([v.max() for v in self.values], np.int64)
        self.low, self.high, self.full = np.where(full, low, np.minimum(low, 0)), np.where(full, high, np.maximum(high, 0)), full

    def competitive(self, query: np.ndarray, beat: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows that score more than `beat`; of all rows if that is None."""
        scores = np.zeros(len(self.ids), np.int64)
        of = self.terms[: np.searchsorted(self.terms, len(query))]
        used = np.flatnonzero(query[of] != 0)
        weights = query[of[used]]
        if len(used) and sum(abs(int(w)) * max(abs(int(a)), abs(int(b))) for w, a, b in zip(weights, self.low[used], self.high[used], strict=True)) >= 2**62:
            raise OverflowError("scores don't fit a long")
        bounds = np.maximum(weights * self.low[used], weights * self.high[used])
        order = np.argsort(-bounds, kind="stable")
        used, weights, bounds = used[order], weights[order], bounds[order]
        #: What the terms from each one on can add together.
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        essential = len(used) if beat is None else int(np.argmax(left <= beat)) if (left <= beat).any() else len(used)
        for i in range(essential):
            scores[self.rows[used[i]]] += weights[i] * self.values[used[i]]
        if beat is None:
            return np.arange(len(scores)), scores
        alive = np.flatnonzero(scores + left[essential] > beat)
        scores = scores[alive]
        for i in range(essential, len(used)):
            if not len(alive):
                break
            rows, values = self.rows[used[i]], self.values[used[i]]
            if self.full[used[i]]:
                scores = scores + weights[i] * values[alive]
            else:
                at = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
                scores = scores + weights[i] * np.where(rows[at] == alive, values[at], 0)
            keep = scores + left[i + 1] > beat
            alive, scores = alive[keep], scores[keep]
        return alive, scores


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """id and vector, floor(scale * x) of each component x as a double, of vectors (vec_id, embedding) without null or non-finite ones."""
    sound = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return vectors.select("vec_id", "embedding").filter(sound).select(
        F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    )


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK, range_rows: int = RANGE) -> DataFrame:
    """query_id, rank, id and score: the k best `rows` (id, vector of longs) for each of `queries` (id, vector), without rows of its own id."""
    spark = rows.sparkSession
    sound = F.expr("id is not null and vector is not null and forall(vector, x -> x is not null)")
    plain = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<long>").alias("vector")).filter(sound).distinct()
    rows, queries = cut(plain(rows)), cut(plain(queries))
    shards = max(parts(spark), -(-rows.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A shard meets each block in a task of its own; a block's queries come after the shard's rows.
    sides = rows.select(dealt(shards).alias("shard"), each(blocks).alias("block"), F.lit(False).alias("asks"), "id", "vector", F.xxhash64("vector").alias("form")).union(
        queries.select(each(shards), dealt(blocks), F.lit(True), "id", "vector", F.xxhash64("vector"))
    )
    placed = sides.repartition(max(parts(spark), shards), "shard", "block").sortWithinPartitions("shard", "block", "asks", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, ids, vectors, postings = None, [], [], None
        for batch in batches:
            found = []
            for at, asks, i, vector, form in zip(zip(batch["shard"], batch["block"], strict=True), batch["asks"], batch["id"], batch["vector"], batch["form"], strict=True):
                if at != place:
                    place, ids, vectors, postings = at, [], [], None
                vector = np.asarray(vector, np.int64)
                if not asks:
                    ids.append(i)
                    vectors.append(vector)
                    continue
                if postings is None:
                    postings, vectors = Postings(np.array(ids, np.int64), vectors, range_rows), []
                best, scores = postings.search(i, vector, k)
                # A query of which an id has several vectors is several queries.
                found.append(pd.DataFrame({"query_id": i, "form": form, "id": best, "score": scores}))
            yield pd.concat(found) if found else pd.DataFrame({"query_id": [], "form": [], "id": [], "score": []})

    best = placed.mapInPandas(run, "query_id long, form long, id long, score long")
    order = Window.partitionBy("query_id", "form").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The contract's columns: queries are the vectors whose vec_id is divisible by `every`."""
    rows = quantised(vectors)
    return top_k(rows, rows.filter(F.col("id") % every == 0), k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
