"""Benchmark decontamination: documents that hold a test item, by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, each class with sizes up to u. An item's sketch is
the bottom floor((1 - share) u) + 1 of its shingles in hash order (bottom-k MinHash), so a document of any length
that contains `share` of an item contains a shingle of its sketch for certain: the search misses nothing.
Documents' shingles above every sketch's largest hash are dropped where they arise; the rest meets the sketches
in a hash join, broadcast only below a checked number of rows. Candidates are verified by exact containment of
shingles as text.

Words are A-Z lower-cased `[^\\x20\\x09-\\x0D]+`. An item of fewer words than a shingle is one shingle, and is
found as that run of words. Defined results: null or empty texts and items match nothing; rows that repeat a
doc_id give one row for each item that any of them holds, with the largest containment; repeated items are one;
null ids stay null. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, cut, texts

#: Rows of a table up to which it is broadcast; beyond it, both sides are shuffled.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _shingle(kind: str, k: int) -> str:
    """SQL for all shingles of k words of the array w: hashes, or texts."""
    at = ", ".join(f"w[i + {j}]" for j in range(k))
    each = f"xxhash64({at})" if kind == "hash" else f"concat_ws(' ', {at})"
    return f"if(size(w) < {k}, array(), transform(sequence(0, size(w) - {k}), i -> {each}))"


def _each(kind: str, sizes: list[int]) -> Column:
    return F.expr(f"concat({', '.join(_shingle(kind, k) for k in sizes)})")


def _small(df: DataFrame) -> DataFrame:
    """`df` to be broadcast if it has few rows; it must be cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item (the item's shingles), n_shared (those in the document), containment; at least `share`."""
    spark = docs.sparkSession
    percent = round(100 * share)
    w = items.select("item_id", _words(F.coalesce("text", F.lit(""))).alias("w")).filter("size(w) > 0")
    w = w.withColumn("k", F.least(F.lit(k), F.size("w")))
    sizes = sorted(r.k for r in w.select("k").distinct().collect())
    empty = spark.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    if not sizes:
        return empty

    def own(kind: str) -> Column:
        case = " ".join(f"when k = {n} then array_distinct({_shingle(kind, n)})" for n in sizes)
        return F.expr(f"case {case} end")

    sets = cut(w.select("item_id", "k", own("hash").alias("hashes"), own("text").alias("shingles")).distinct())
    upper = "cast(pow(2, floor(log2(size(hashes))) + 1) - 1 as int)"
    sketch = cut(
        sets.withColumn("bottom", F.expr(f"{upper} - cast(ceil({percent} * {upper} / 100D) as int) + 1"))
        .select("item_id", F.explode(F.expr("slice(array_sort(hashes), 1, bottom)")).alias("h"))
        .distinct()
    )
    top = sketch.agg(F.max("h")).first()[0]
    named = texts(docs).withColumn("fp", F.xxhash64("text"))
    found = (
        named.select("doc_id", "fp", _words(F.col("text")).alias("w"))
        .filter(f"size(w) >= {sizes[0]}")
        .select("doc_id", "fp", F.explode(F.filter(_each("hash", sizes), lambda h: h <= top)).alias("h"))
    )
    candidates = cut(found.join(_small(sketch), "h").select("doc_id", "fp", "item_id").distinct())
    whole = candidates.join(
        sets.select("item_id", F.size("shingles").cast("long").alias("n_item"), "shingles"), candidates.item_id.eqNullSafe(sets.item_id)
    ).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), candidates.item_id.alias("item_id"), "n_item", "shingles")
    suspects = _small(candidates.select(F.col("doc_id").alias("d"), F.col("fp").alias("f")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    held = named.join(suspects, same, "left_semi").select(
        "doc_id", "fp", _words(F.col("text")).alias("w")
    ).select("doc_id", "fp", F.array_distinct(_each("text", sizes)).alias("held"))
    return (
        held.join(whole, same)
        .select("doc_id", "item_id", "n_item", F.size(F.array_intersect("shingles", "held")).cast("long").alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .groupBy("doc_id", "item_id")
        .agg(F.max_by("n_item", F.col("n_shared") / F.col("n_item")).alias("n_item"), F.max_by("n_shared", F.col("n_shared") / F.col("n_item")).alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )


_SHINGLES = """list_transform(range(1, len(w) - least(5, {n}) + 2), lambda i: array_to_string(w[i:i + least(5, {n}) - 1], ' '))"""
ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, least(5, len(w)) AS k, unnest(list_distinct({_SHINGLES.format(n="len(w)")})) AS x FROM t WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
h AS (SELECT DISTINCT doc_id, k, x FROM (
       SELECT doc_id, k, unnest(CASE WHEN len(w) < k THEN [] ELSE
         list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) END) AS x
       FROM d, (SELECT DISTINCT k FROM s)))
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM s JOIN h USING (k, x) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""
