"""Reading the driver's tables through Spark's readers only, and cutting lineage in shared storage."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on any file system that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt by `by` to as many tasks as the session shuffles to.

    A small compressed file holds many rows and is one task's: what its rows are expanded to would be that task's too.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut, in the shared folder that the session names in spark.checkpoint.dir.

    A session on a cluster that names none is an error: rounds would compute all earlier rounds again. Only a local
    session (tests) gets a temporary folder. Set spark.cleaner.referenceTracking.cleanCheckpoints to have checkpoints
    deleted once nothing refers to them.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


#: Rows that may be sent to every task.
MOST_SENT = 100_000


def sent(df: DataFrame) -> DataFrame:
    """`df` written, and sent to every task in joins if it has at most MOST_SENT rows, by shuffles if it has more.

    For few keys against many rows: a join by shuffles would sort all rows of a key in one task.
    """
    df = cut(df)
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below the one that the session shares: for what is written and read again."""
    import uuid

    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
