"""Cutting lineage, and small sequences."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share its local folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in ``spark.checkpoint.dir``.

    A session on a single machine without that setting gets a folder of its own; on a
    cluster it raises, as executors don't see the driver's folders.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lexivane-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/lexivane/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation, and what several later
    steps read is computed once.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer splits than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that one task of a dealt table gets, about.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by keys to so many tasks that each gets about ``ROWS_A_TASK`` of ``rows``.

    A task's memory then doesn't grow with the table. As it is where the session's own
    number of shuffle partitions is enough for that.
    """
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place`` (long, from 1) by an order, without one task that sees all rows.

    Rows are sorted by ranges and kept; what comes to the driver is a count for each range.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, before = [], 0
    for r in counts:
        starts.append((r["_part"], before))
        before += r["n"]
    # A row a partition.
    table = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return ranged.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("place", F.col("_start") + inside + 1).drop("_part", "_start", "_at")


def drawn(*keys):
    """A number of 60 bits that depends on the keys only: the head of their MD5 digest, which any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 15), 16, 10).cast("long")


def up_to(n):
    """1 .. n as an array; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
