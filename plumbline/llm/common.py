"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: fixed values of the contracts.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark deletes a query's shuffle files when it ends.
_DELETES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut, in the shared folder that the session names.

    Its shuffle files are deleted once it is written: nothing reads them again. Only a local session that names no
    folder (tests) gets a temporary one.
    """
    return _written(df, lambda some, folder: some.checkpoint())


def stored(df: DataFrame) -> DataFrame:
    """As `cut`, but as Parquet in that folder: slower to write, and a fraction of the room."""

    def write(some: DataFrame, folder: str) -> DataFrame:
        path = f"{folder}/{uuid.uuid4()}"
        some.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return _written(df, write)


def _written(df: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    before = spark.conf.get(_DELETES, "false")
    spark.conf.set(_DELETES, "true")
    try:
        return write(df.select("*"), sc.getCheckpointDir())
    finally:
        spark.conf.set(_DELETES, before)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row, null text as empty; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter; pure ASCII text takes the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(buckets: int, bucket: int) -> Column:
    """Whether crc32 of doc_id as text falls into `bucket` of `buckets`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % buckets == bucket


def frequent(df: DataFrame, column: str, most: int) -> DataFrame:
    """Rows whose count in `column` reaches a level that at most `most` rows reach; levels come from a histogram.

    Unlike a sort with a limit, no partition sends its own best rows anywhere.
    """
    level = F.floor(F.log2(column) * 32)
    sizes = sorted(((r.level, r["count"]) for r in df.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, n = None, 0
    for at, k in sizes:
        n += k
        if n > most:
            break
        least = at
    return df.filter(level >= least) if least is not None else df.limit(0)


#: Bits of the map of ids that goes to tasks: 2,049 rows of 4 KB at the most.
ID_BITS = 1 << 26


def among(rows: DataFrame, ids: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of `rows` whose doc_id (or `on`, which holds it) is in `ids` (distinct, other columns stay), however many those are.

    Rows meet ids in a shuffle. A map of hashed ids, of a fixed size, first drops most of the others where they lie.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    held = ids.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(held), (F.bitmap_bucket_number(place) == F.col("bucket")) & (F.getbit(byte, at % 8) == 1), "left_semi")
    return near.join(ids.hint("shuffle_hash"), on or ["doc_id"])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of undirected `edges` (a, b): node and component_id, its smallest node.

    Each round, every node hooks its neighbours' labels to the smallest of them, and labels then jump to
    their own labels, so that chains shorten by more than half. Rows of a hub are combined before they are
    shuffled. Each round is checkpointed; the end is seen from one count.
    """
    spark = edges.sparkSession
    if edges.isEmpty():
        return spark.createDataFrame([], "node long, component_id long")
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # What a node learns also goes to the node that its label names.
        hooked = cut(
            low.select("node", "low", F.when(F.col("low") < F.col("label"), 1).otherwise(0).alias("changed"))
            .union(low.filter("low < label").select(F.col("label"), "low", F.lit(1)))
            .groupBy("node")
            .agg(F.min("low").alias("low"), F.max("changed").alias("changed"))
        )
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        labels = cut(
            hooked.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("label"), "changed")
        )
        if labels.filter("changed = 1").isEmpty():
            return labels.select("node", F.col("label").alias("component_id"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
