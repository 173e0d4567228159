"""Line dedup: common lines stay in one document and leave all others.

The occurrences of long lines go, as pairs of 64-bit hashes, through one range partitioning with a secondary
sort by document; each partition streams over its runs and gives one partial row per line, so that a line that
stands in a third of all documents is counted by many tasks. What comes back to the documents is a bitmap of
lines to drop, not text.

Defined results: null text is one empty line, and so is empty text. Rows that repeat a doc_id and its text are
one document, and each row gets the same result; a null doc_id is smaller than any other. Lines of a key that
repeat within the document that keeps it all stay. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, ascii_lower, cut, parts, texts

#: Lines a bitmap word: 63, so that words never turn negative.
BITS = 63


def _identified(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("fp", F.xxhash64("text"))


def drop_bitmaps(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, fp (hash of the text) and drops, for documents that lose lines.

    drops holds (word, bits) with the words of the document's bitmap that have a bit set: bit i of word w stands
    for line 63 w + i. Words without a dropped line aren't stored.
    """
    n = parts(docs.sparkSession)
    lines = _identified(docs).select("doc_id", "fp", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")))
    key = F.btrim("col", F.lit(SPACE))
    found = cut(
        lines.filter(F.length("col") >= min_length)
        .select("doc_id", "fp", "pos", key.alias("key"))
        .filter(F.length("key") >= min_length)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("line")).alias("h2"), "doc_id", "fp", "pos")
    )
    ranged = found.select("h1", "h2", "doc_id").repartitionByRange(n, "h1", "h2", F.desc("doc_id"))
    # Written, so that the join below reads both sides from plain exchanges and Spark can split a very common line.
    common = cut(
        ranged.sortWithinPartitions("h1", "h2", F.desc("doc_id"))
        .groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    dropped = found.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    return (
        dropped.groupBy("doc_id", "fp", F.expr(f"cast(pos div {BITS} as int)").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc_id", "fp")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))
    )


def dedup_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of `docs`: doc_id, text, n_lines, n_dropped and kept (its text without the dropped lines)."""
    flags = drop_bitmaps(docs, min_length, min_docs).select(
        F.col("doc_id").alias("d_id"), F.col("fp").alias("d_fp"), "drops"
    )
    whole = _identified(docs)
    both = whole.join(
        flags.hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("fp") == F.col("d_fp")),
        "left",
    )
    words = F.expr(f"transform(sequence(0, cast(n_lines div {BITS} as int)), w -> coalesce(drops[w], 0L))")
    kept = F.expr(
        f"""array_join(filter(split(text, '\n'),
            (line, i) -> shiftright(words[cast(i div {BITS} as int)], i % {BITS}) & 1 = 0), '\n')"""
    )
    return (
        both.withColumn("n_lines", F.octet_length("text") - F.octet_length(F.expr("replace(text, '\n', '')")) + 1)
        .withColumn("words", F.when(F.col("drops").isNotNull(), words))
        .select(
            "doc_id",
            "text",
            F.col("n_lines").cast("long").alias("n_lines"),
            F.when(F.col("drops").isNull(), F.lit(0))
            .otherwise(F.expr("aggregate(words, 0, (n, w) -> n + bit_count(w))"))
            .cast("long")
            .alias("n_dropped"),
            F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        )
    )


def strip_lines(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has lost its common lines; n_chars follows if there."""
    gone = dedup_lines(docs, min_length, min_docs).filter("n_dropped > 0")
    gone = gone.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("fp"), "kept").dropDuplicates(["id", "fp"])
    packed = docs.select(F.struct("*").alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    both = packed.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("fp")), "left")
    new = {"text": F.coalesce("kept", "row.text"), "n_chars": F.coalesce(F.length("kept").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return both.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \\t\\n\\x0b\\x0c\\r'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\\n') AS list FROM documents))),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\\n' ORDER BY pos)
              FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""
