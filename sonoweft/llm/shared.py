"""Tables in the folder that all executors share, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set, but only in local
    mode: on a cluster a machine's own folder would not be seen by the others.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has (whatever the case of its letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; this cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame, folder: str) -> DataFrame:
    """Adds the rows of ``df`` to the table in ``folder`` and reads the whole of it.

    A table that grows by rounds is one scan this way, however many rounds there
    were; a union of their tables makes larger plans for the driver each round.
    """
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str, rank: str = "rank") -> DataFrame:
    """Adds the gapless rank (from 0) of each row among those with equal ``keys``.

    Rows are dealt by ranges of (keys, order), so that a key with most of the
    rows still spreads over many tasks. The counts that shift the ranks of a
    partition have one row for each partition and key it holds: at most the
    number of partitions plus the number of distinct keys, whatever the rows.
    Callers pass keys with a fixed number of values.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = materialize(laid.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33).alias("_part")
    counts = laid.groupBy(*keys, part).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.shiftright("_row", 33) == F.col("_part")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = laid.join(F.broadcast(counts), same)
    return joined.withColumn(rank, F.col("_row") + F.col("_shift")).select(*df.columns, rank)
