"""Paired comparison of two rankings' scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many non-zero differences the signed-rank test is exact, if there are no ties.
EXACT_PAIRS = 50


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, d) of two (query_id, score) tables with the same ids, else it raises."""
    a, b = first.select("query_id", F.col("score").alias("a")), second.select("query_id", F.col("score").alias("b"))
    rows = a.join(b, "query_id", "full_outer")
    one = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a query is scored on one side only")).cast("double"))
    return rows.select("query_id", one.otherwise(F.col("a") - F.col("b")).alias("d"))


def summary(differences: DataFrame) -> DataFrame:
    """One row: n, mean_difference, sd, t, wins_first, wins_second, ties."""
    row = differences.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("wins_first"), F.count_if(F.col("d") < 0).alias("wins_second"), F.count_if(F.col("d") == 0).alias("ties"))
    return row.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_difference") / (F.col("sd") / F.sqrt("n"))).otherwise(F.lit(0.0)))


def signed_ranks(differences: DataFrame) -> DataFrame:
    """(query_id, d, rank) of the non-zero differences: mean ranks of their sizes.

    Ranks come from counts of equal sizes, so only distinct sizes meet in one window.
    """
    some = differences.where("d <> 0").withColumn("size", F.round(F.abs("d"), 12))
    sizes = some.groupBy("size").agg(F.count("*").alias("same"))
    below = F.coalesce(F.sum("same").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.join(sizes.select("size", (below + (F.col("same") + 1) / 2.0).alias("rank")), "size").select("query_id", "d", "rank")


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1 - x, b, a)
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for m in range(500):
        half = m // 2
        if m == 0:
            k = 1.0
        elif m % 2 == 0:
            k = half * (b - half) * x / ((a + 2 * half - 1) * (a + 2 * half))
        else:
            k = -(a + half) * (a + b + half) * x / ((a + 2 * half) * (a + 2 * half + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        out *= c * d
        if m and abs(c * d - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a * (out - 1)


def t_p_value(t: float, df: int) -> float:
    return beta_tail(df / (df + t * t), df / 2, 0.5)


def wilcoxon_p_value(ranks: np.ndarray, positive: float) -> float:
    """Two-sided p of the sum of positive ranks: exact for few untied pairs, else normal with tie correction."""
    n, total = len(ranks), float(ranks.sum())
    low = min(positive, total - positive)
    _, same = np.unique(ranks, return_counts=True)
    if n <= EXACT_PAIRS and (same == 1).all():
        ways = np.zeros(int(total) + 1)
        ways[0] = 1.0
        for r in ranks.astype(int):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - float((same.astype(float) ** 3 - same).sum()) / 48
    return math.erfc(abs(low - total / 2) / math.sqrt(variance) / math.sqrt(2))


def bootstrap_interval(d: np.ndarray, seed: int = 42, resamples: int = 10_000) -> tuple[float, float]:
    """Percentile interval of 95 % for the mean; indices are drawn 256 resamples at a time."""
    rng, means = np.random.default_rng(seed), []
    while (left := resamples - sum(map(len, means))) > 0:
        means.append(d[rng.integers(0, len(d), size=(min(256, left), len(d)))].mean(axis=1))
    low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
    return float(low), float(high)


@dataclass(frozen=True)
class Comparison:
    n: int
    mean_difference: float
    t: float
    t_p: float
    w: float
    w_p: float
    interval: tuple[float, float]
    wins_first: int
    wins_second: int
    ties: int


def compare(first: DataFrame, second: DataFrame, seed: int = 42, resamples: int = 10_000) -> Comparison:
    """Paired t-test, Wilcoxon signed-rank test and bootstrap interval of first minus second.

    Differences, one a query of a labelled set, come to the driver for the tests.
    """
    if resamples < 1:
        raise ValueError("at least one resample is needed")
    rows = paired(first, second).orderBy("query_id").collect()
    if len(rows) < 2:
        raise ValueError("a paired test needs two queries or more")
    d = np.array([r["d"] for r in rows])
    n, mean = len(d), float(d.mean())
    counts = (int((d > 0).sum()), int((d < 0).sum()), int((d == 0).sum()))
    if not d.any():
        return Comparison(n, mean, 0.0, 1.0, 0.0, 1.0, (0.0, 0.0), *counts)
    if np.allclose(d, d[0], rtol=1e-12, atol=1e-15):
        t, p = math.copysign(math.inf, mean), 0.0
    else:
        t = mean / (float(d.std(ddof=1)) / math.sqrt(n))
        p = t_p_value(t, n - 1)
    some = d[d != 0]
    _, place, same = np.unique(np.abs(some), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(same) - (same - 1) / 2)[place]
    up = float(ranks[some > 0].sum())
    return Comparison(n, mean, t, p, min(up, float(ranks.sum()) - up), wilcoxon_p_value(ranks, up), bootstrap_interval(d, seed, resamples), *counts)
