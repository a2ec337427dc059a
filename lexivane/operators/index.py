"""Inverted index as tables. A snapshot is immutable; changes make a new version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions.tables import dealt, small
from lexivane.functions.text import indexed_text, tokenize


@dataclass(frozen=True)
class Index:
    """``docs``: (doc_id, terms). Everything else derives from it, lazily."""

    docs: DataFrame
    version: int = 0
    tokenizer: Callable[[Column], Column] = tokenize

    @cached_property
    def doc_stats(self) -> DataFrame:
        """(doc_id, doc_len): terms of each document, empty ones too."""
        return self.docs.select("doc_id", F.size("terms").alias("doc_len"))

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, doc_len): the length goes along, so that rankers need no join.

        A document is one input row, so the partial aggregation before the shuffle has
        already counted all there is: only distinct (document, term) pairs move.
        """
        each = self.docs.select("doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
        return each.groupBy("doc_id", "doc_len", "term").agg(F.count("*").cast("int").alias("tf")).select("term", "doc_id", "tf", "doc_len")

    @cached_property
    def term_stats(self) -> DataFrame:
        """(term, df), the vocabulary; counted from distinct terms within rows, without the postings."""
        each = self.docs.select(F.explode(F.array_distinct("terms")).alias("term"))
        return each.groupBy("term").agg(F.count("*").alias("df"))

    @cached_property
    def corpus_stats(self) -> DataFrame:
        """One row: n_docs, avg_len (0 without documents)."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("terms")), F.lit(0.0)).alias("avg_len"))

    def matches(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id, tf, doc_len) of the given terms.

        Documents are filtered to the terms before they are counted; over an index that is
        clustered by document nothing moves.
        """
        each = self.docs.select("doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term")).join(terms, "term", "left_semi")
        return each.groupBy("doc_id", "doc_len", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "doc_len")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, df) of the given terms."""
        return self.docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))

    def term_postings(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")

    def document_ids(self) -> DataFrame:
        return self.docs.select("doc_id").orderBy("doc_id")

    def terms(self) -> DataFrame:
        return self.term_stats.select("term").orderBy("term")

    def num_docs(self) -> int:
        return self.docs.count()

    def doc_freq(self, term: str) -> int:
        return self.docs.where(F.array_contains("terms", term)).count()

    def doc_length(self, doc_id: str) -> int:
        row = self.doc_stats.where(F.col("doc_id") == doc_id).first()
        if row is None:
            raise KeyError(doc_id)
        return row["doc_len"]

    def add(self, documents: DataFrame) -> Index:
        """A snapshot with further (doc_id, title, body); an id that is there raises."""
        new = _terms(documents, self.tokenizer)
        if not new.join(self.docs, "doc_id", "left_semi").isEmpty():
            raise ValueError("a document with this id already exists")
        _check_unique(new)
        return Index(self.docs.unionByName(new), self.version + 1, self.tokenizer)

    def remove(self, doc_ids: DataFrame) -> Index:
        """A snapshot without these doc_id; unknown ones change nothing."""
        gone = doc_ids.select("doc_id").distinct()
        if self.docs.join(gone, "doc_id", "left_semi").isEmpty():
            return self
        return Index(self.docs.join(gone, "doc_id", "left_anti"), self.version + 1, self.tokenizer)


@dataclass(frozen=True)
class StoredIndex(Index):
    """An index read from the tables that ``store`` wrote; texts aren't tokenized again.

    ``documents`` has a row a document with its different terms and their counts, so a
    scan by document needs no shuffle to count. ``postings`` and ``terms`` are sorted by
    ranges of the term: a look-up of a term, or of a prefix, prunes to the files and row
    groups that can hold it.
    """

    folder: str = ""

    def _table(self, name: str) -> DataFrame:
        return self.docs.sparkSession.read.schema(STORED[name]).parquet(f"{self.folder}/{name}")

    @cached_property
    def doc_stats(self) -> DataFrame:
        return self._table("documents").select("doc_id", "doc_len")

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings")

    @cached_property
    def term_stats(self) -> DataFrame:
        return self._table("terms")

    @cached_property
    def corpus_stats(self) -> DataFrame:
        return self._table("corpus")

    def matches(self, terms: DataFrame) -> DataFrame:
        each = self._table("documents").select("doc_id", "doc_len", F.explode("counts").alias("c"))
        return each.select(F.col("c.term").alias("term"), "doc_id", F.col("c.tf").alias("tf"), "doc_len").join(small(terms), "term", "left_semi")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        return self.term_stats.join(small(terms), "term", "left_semi")

    def doc_freq(self, term: str) -> int:
        row = self.term_stats.where(F.col("term") == term).first()
        return row["df"] if row else 0


#: For the number of tasks of a clustered index: rows that a document's terms make, about.
TERMS_A_DOCUMENT = 100

STORED = {
    "documents": "doc_id string, doc_len int, terms array<string>, counts array<struct<term:string,tf:int>>",
    "postings": "term string, doc_id string, tf int, doc_len int",
    "terms": "term string, df long",
    "corpus": "n_docs long, avg_len double",
}


def store(index: Index, folder: str) -> StoredIndex:
    """Write an index as tables below ``folder``, which is new, and open it. Texts are tokenized once."""
    spark = index.docs.sparkSession
    # Equal terms stand together once sorted (``array_sort`` would call a comparator for each pair); where a run of them begins, its length is the count.
    ordered = index.docs.select("doc_id", "terms", F.sort_array("terms").alias("s"))
    ordered = ordered.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.size("s")), lambda i: (i == F.size("s")) | (i == 0) | (F.get("s", i) != F.get("s", i - 1))))
    counts = F.transform(F.slice("firsts", 1, F.size("firsts") - 1), lambda a, k: F.struct(F.get("s", a).alias("term"), (F.get("firsts", k + 1) - a).alias("tf")))
    ordered.select("doc_id", F.size("terms").alias("doc_len"), "terms", F.when(F.size("s") > 0, counts).otherwise(F.expr("cast(array() as array<struct<term:string,tf:int>>)")).alias("counts")).write.parquet(f"{folder}/documents")
    documents = spark.read.schema(STORED["documents"]).parquet(f"{folder}/documents")
    each = documents.select("doc_id", "doc_len", F.explode("counts").alias("c")).select("c.term", "doc_id", "c.tf", "doc_len")
    each.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
    stats = spark.read.schema(STORED["postings"]).parquet(f"{folder}/postings").groupBy("term").agg(F.count("*").alias("df"))
    stats.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len")).write.parquet(f"{folder}/corpus")
    return open_index(spark, folder, index.version, index.tokenizer)


def open_index(spark: SparkSession, folder: str, version: int = 1, tokenizer: Callable[[Column], Column] = tokenize) -> StoredIndex:
    """The index that ``store`` wrote to ``folder``."""
    docs = spark.read.schema(STORED["documents"]).parquet(f"{folder}/documents").select("doc_id", "terms")
    return StoredIndex(docs, version, tokenizer, folder)


def _terms(documents: DataFrame, tokenizer) -> DataFrame:
    return documents.select("doc_id", tokenizer(indexed_text(F.col("title"), F.col("body"))).alias("terms"))


def _check_unique(docs: DataFrame) -> None:
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("a document with this id already exists")


def build_index(documents: DataFrame, tokenizer: Callable[[Column], Column] = tokenize, check: bool = False, cluster: bool = False) -> Index:
    """Index (doc_id, title, body). With ``check``, repeated ids raise (an extra pass).

    ``cluster`` deals documents out by id first. That one shuffle of texts serves all that
    is later grouped by document (postings, norms, scores by query and document), which
    then moves nothing; scans that only filter don't need it.
    """
    if cluster:
        some = dealt(documents, documents.count() * TERMS_A_DOCUMENT, "doc_id")
        documents = documents.repartition("doc_id") if some is documents else some
    docs = _terms(documents, tokenizer)
    if check:
        _check_unique(docs)
    return Index(docs, version=1, tokenizer=tokenizer)
