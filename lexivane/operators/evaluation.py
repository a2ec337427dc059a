"""Offline evaluation of rankings against binary relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """precision, recall, rr, ndcg of each labelled query (and each value of ``by``).

    Queries without labels are left out; labelled ones without a hit score 0. ``ranked``
    holds (query_id, rank, doc_id, *by); ranks above k don't count.
    """
    keys = [*by, "query_id"]
    labelled = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel")).join(queries.select("query_id").distinct(), "query_id", "left_semi")
    marks = ranked.where(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"])
    sums = marks.groupBy(*keys).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    if by:
        labelled = labelled.crossJoin(F.broadcast(ranked.select(*by).distinct()))
    rows = labelled.join(sums, keys, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(max(k, 1))).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if k <= 0:
        return rows.select(*keys, *[F.lit(0.0).alias(c) for c in ("precision", "recall", "rr", "ndcg")])
    return rows.select(
        *keys,
        zero(F.col("hits") / k).alias("precision"),
        zero(F.col("hits") / F.col("n_rel")).alias("recall"),
        zero(1.0 / F.col("first")).alias("rr"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def mean_metrics(ranked: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over labelled queries: precision, recall, mrr, ndcg; 0 without any."""
    rows = per_query(ranked, queries, qrels, k, by)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy(*by).agg(mean("precision").alias("precision"), mean("recall").alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"))


def per_query_ndcg(ranked: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    return per_query(ranked, queries, qrels, k).select("query_id", "ndcg")


def best_setting(grid_metrics: DataFrame) -> DataFrame:
    """The grid point with the largest NDCG, the first on ties; no point raises."""
    if grid_metrics.isEmpty():
        raise ValueError("the grid is empty")
    return grid_metrics.orderBy(F.round("ndcg", 12).desc(), "grid_pos").limit(1)


def grid_table(grid_metrics: DataFrame, k1s) -> DataFrame:
    """NDCG with a row for each b and a column for each k1."""
    return grid_metrics.groupBy("b").pivot("k1", [float(x) for x in k1s]).agg(F.first("ndcg")).orderBy("b")


def rmse(pairs: DataFrame) -> DataFrame:
    """Root mean square error of (actual, predicted) rows; none raise."""
    if pairs.isEmpty():
        raise ValueError("an error needs at least one pair")
    return pairs.agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("actual"), F.lit(2.0)))).alias("rmse"))
