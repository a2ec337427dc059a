"""Shared folder, written tables and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import tables

WORD = r"[^\x20\x09-\x0D]+"
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, in ``spark.checkpoint.dir``.

    Only a session without that setting on a single machine, as in tests, gets a folder of
    its own; on a cluster it raises.
    """
    _made.append(tables.new_folder(spark, name))
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation, and a table that
    several later steps read is computed once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete every folder that this module made for the session, but for the first ``keep``."""
    jvm = spark.sparkContext._jvm
    while len(_made) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_stages(spark: SparkSession, docs: DataFrame, stages) -> DataFrame:
    """``docs`` through (name, function of docs) stages; each but the last is written.

    When a stage is written, the tables that it made on its way are deleted, and so is the
    stage before it.
    """
    *inner, (_, last) = stages
    kept = len(_made)
    for name, stage in inner:
        made = len(_made)
        out = stage(docs)
        path = new_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        _made.remove(path)
        before = _made[kept:made]
        release(spark, made)
        del _made[kept:made]
        _made.extend([path, *before])
        release(spark, kept + 1)
        docs = spark.read.schema(out.schema).parquet(path)
    return last(docs)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The named column, or typed nulls where the table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside higher-order functions Catalyst may inline an expression where it is
    used; a lambda variable can't be inlined.
    """
    return F.transform(F.array(value), body)[0]
