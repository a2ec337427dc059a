"""TF-IDF and BM25 ranking of a batch of queries in one job."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.driver import ResultCache
from lexivane.functions.tables import cut, small
from lexivane.operators.index import Index

#: Scores are compared at this many decimals: sums of equal parts may differ in the last bit.
DECIMALS = 9


def top_k(scored: DataFrame, k: int, by: Iterable[str] = ("query_id",), item: str = "doc_id") -> DataFrame:
    """``rank`` 1 to k per group by descending score, ties by ascending item; k <= 0 gives none."""
    if k <= 0:
        return scored.where(F.lit(False)).withColumn("rank", F.lit(0))
    order = Window.partitionBy(*by).orderBy(F.round("score", DECIMALS).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a term that a query repeats counts as often."""
    each = queries.select("query_id", F.explode(index.tokenizer(F.col("text"))).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def hits(index: Index, queries: DataFrame) -> DataFrame:
    """Postings of the queries' terms with all that a score needs.

    A query side that is counted to be small is sent out, so rows stay with their document.
    The few counts that match are dealt by document, once for all queries and settings: scores
    are then summed up and cut to the k best where they are, and no row for each query and
    document moves.
    """
    asked = cut(query_terms(index, queries))
    wanted = small(asked.select("term").distinct())
    sides = small(cut(asked.join(index.frequencies(wanted), "term")))
    # One row: a bound that doesn't grow with the data.
    return index.matches(wanted).repartition("doc_id").join(sides, "term").crossJoin(F.broadcast(index.corpus_stats))


class Ranker(ABC):
    """Scores batches of (query_id, text); single queries go through a result cache."""

    def __init__(self, index: Index, cache_size: int = 256):
        self.index, self.cache = index, ResultCache(cache_size)

    @abstractmethod
    def contribution(self) -> Column:
        """What one occurrence of a query term adds to a document's score."""

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of every document with a query term, score 0 too."""
        found = hits(self.index, queries)
        return found.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * self.contribution()).alias("score"))

    def rank(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return top_k(self.scores(queries), k)

    def rank_text(self, text: str, k: int = 10) -> list[tuple[str, float]]:
        """(doc_id, score) of one query, kept by index version, text and k."""

        def run():
            spark = self.index.docs.sparkSession
            rows = self.rank(spark.createDataFrame([("q", text)], "query_id string, text string"), k).orderBy("rank").collect()
            return tuple((r["doc_id"], r["score"]) for r in rows)

        return list(self.cache.get((self.index.version, text, k), run)) if k > 0 else []


class TfIdf(Ranker):
    """(1 + ln tf) ln(N / df)."""

    def contribution(self) -> Column:
        return (1 + F.log("tf")) * F.log(F.col("n_docs") / F.col("df"))


def bm25_idf() -> Column:
    return F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25_part(k1: Column, b: Column) -> Column:
    ratio = F.when(F.col("avg_len") > 0, F.col("doc_len") / F.col("avg_len")).otherwise(0.0)
    return bm25_idf() * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * ratio))


def check_bm25(k1: float, b: float) -> None:
    if k1 <= 0:
        raise ValueError("k1 must be positive")
    if not 0 <= b <= 1:
        raise ValueError("b must be between 0 and 1")


class Bm25(Ranker):
    def __init__(self, index: Index, k1: float = 1.5, b: float = 0.75, cache_size: int = 256):
        check_bm25(k1, b)
        super().__init__(index, cache_size)
        self.k1, self.b = k1, b

    def contribution(self) -> Column:
        return bm25_part(F.lit(float(self.k1)), F.lit(float(self.b)))


K1_GRID, B_GRID = (0.9, 1.2, 1.5, 2.0), (0.4, 0.75, 0.9)


def bm25_grid(index: Index, queries: DataFrame, k: int = 10, k1s=K1_GRID, bs=B_GRID) -> DataFrame:
    """(grid_pos, k1, b, query_id, doc_id, score, rank) of every setting, in one job.

    A score column for each setting is summed in the same aggregation. The k best of one
    setting give a floor for every other: no document below all floors can be among any
    setting's k best, so few are spread out to rows. Sums are made twice, for the floors and
    for what is above them, and never written.
    """
    grid = [(i, float(k1), float(b)) for i, (k1, b) in enumerate((k1, b) for k1 in k1s for b in bs)]
    for _, k1, b in grid:
        check_bm25(k1, b)
    sums = [F.sum(F.col("qtf") * bm25_part(F.lit(k1), F.lit(b))).alias(f"s{i}") for i, k1, b in grid]
    wide = hits(index, queries).groupBy("query_id", "doc_id").agg(*sums)
    exact = lambda i: F.round(f"s{i}", DECIMALS)
    lead = top_k(wide.withColumn("score", F.col(f"s{len(grid) // 2}")), k)
    floors = lead.groupBy("query_id").agg(F.count("*").alias("n"), *[F.min(exact(i)).alias(f"f{i}") for i, _, _ in grid])
    above = F.col("n") < k
    for i, _, _ in grid:
        above = above | (exact(i) >= F.col(f"f{i}"))
    kept = wide.join(small(cut(floors)), "query_id").where(above)
    cells = F.array(*[F.struct(F.lit(i).alias("grid_pos"), F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, k1, b in grid])
    long = kept.select("query_id", "doc_id", F.explode(cells).alias("c")).select("c.grid_pos", "c.k1", "c.b", "query_id", "doc_id", "c.score")
    return top_k(long, k, by=("grid_pos", "query_id"))
