"""Corpus, query and relevance files as DataFrames, read with fixed schemas and strictly."""

from __future__ import annotations

import os
import shutil
import urllib.request
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _required(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"missing field {name}"))).otherwise(F.col(name)).cast("string")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, body) of JSON lines with ``_id``, ``title`` and ``text``.

    Blank lines and further fields are ignored; bad JSON and missing fields raise.
    """
    raw = spark.read.schema("_id string, title string, text string").option("mode", "FAILFAST").json(path)
    return raw.select(_required("_id").alias("doc_id"), _required("title").alias("title"), _required("text").alias("body"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of JSON lines with ``_id`` and ``text``; of equal ids the last line counts."""
    raw = spark.read.schema("_id string, text string").option("mode", "FAILFAST").json(path)
    rows = raw.select(_required("_id").alias("query_id"), _required("text").alias("text")).withColumn("line", F.monotonically_increasing_id())
    return rows.groupBy("query_id").agg(F.max_by("text", "line").alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (query_id, doc_id) with a positive grade, of tab-separated lines of three cells.

    Cells may be quoted. Lines whose first cell is ``query-id``, in any case, are headers;
    another number of cells, or a grade that is no number, raises; cells are trimmed; blank
    lines are skipped; a query without a positive grade is absent.
    """
    schema = "query_id string, doc_id string, grade string, more string"
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line", "emptyValue": "", "nullValue": "\x00"}
    rows = spark.read.schema(f"{schema}, line string").options(**options).csv(path)
    rows = rows.where(F.lower(F.trim("query_id")) != "query-id")
    # Three cells of the four in the schema are what the reader calls a corrupt line.
    three = F.col("line").isNotNull() & F.col("grade").isNotNull() & F.col("more").isNull()
    cell = lambda c: F.when(three, F.trim(c)).otherwise(F.raise_error(F.lit("qrels lines need three cells")))
    found = rows.select(cell("query_id").alias("query_id"), cell("doc_id").alias("doc_id"), cell("grade").cast("int").alias("grade"))
    return found.where("grade > 0").select("query_id", "doc_id").distinct()


def merge_qrels(*parts: DataFrame) -> DataFrame:
    """Union of relevance sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def extract_archive(archive: str, folder: str, prefix: str = "") -> dict[str, str]:
    """Unpack the corpus, query and qrels members below ``prefix``; gives their places."""
    members = {"corpus": "corpus.jsonl", "queries": "queries.jsonl", "train": "qrels/train.tsv", "test": "qrels/test.tsv"}
    out = {}
    with zipfile.ZipFile(archive) as z:
        for name, member in members.items():
            out[name] = os.path.join(folder, member)
            os.makedirs(os.path.dirname(out[name]), exist_ok=True)
            with z.open(f"{prefix}{member}") as source, open(out[name], "wb") as target:
                shutil.copyfileobj(source, target)
    return out


def download(url: str, destination: str, timeout: float = 60) -> str:
    """Fetch a file unless it is there; it appears under its name only when complete."""
    if not os.path.exists(destination):
        part = f"{destination}.part"
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as target:
                shutil.copyfileobj(source, target)
            os.replace(part, destination)
        finally:
            if os.path.exists(part):
                os.unlink(part)
    return destination


#: Fixed columns of an evaluation's results.
RESULT_COLUMNS = ("ranker", "parameters", "precision@10", "recall@10", "MRR", "NDCG@10", "average_query_latency_ms")


def write_results_csv(results: DataFrame, path: str) -> None:
    """The result columns of evaluation rows, in their order, as one CSV file with a header."""
    missing = [c for c in RESULT_COLUMNS if c not in results.columns]
    if missing:
        raise ValueError(f"results lack {', '.join(missing)}")
    results.select(*[f"`{c}`" for c in RESULT_COLUMNS]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def from_tables(documents: DataFrame) -> DataFrame:
    """(doc_id, title, body) of a (doc_id, text) table."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def last_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
