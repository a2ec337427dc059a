"""Incremental indexing of a document stream (an extension: batches become index versions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexivane.functions.text import indexed_text, tokenize
from lexivane.operators.index import Index


def index_stream(documents: DataFrame, path: str, checkpoint: str, tokenizer=tokenize) -> StreamingQuery:
    """Append the terms of streamed (doc_id, title, body) to a table partitioned by version.

    A micro-batch writes its own partition and overwrites it if it is repeated, so a
    restart neither loses nor doubles documents.
    """
    terms = documents.select("doc_id", tokenizer(indexed_text(F.col("title"), F.col("body"))).alias("terms"))

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    return terms.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The snapshot of a version, by default the latest."""
    rows = spark.read.parquet(path)
    latest = rows.agg(F.max("version")).first()[0]
    version = latest if version is None else version
    return Index(rows.where(F.col("version") <= version).select("doc_id", "terms"), version=version)
