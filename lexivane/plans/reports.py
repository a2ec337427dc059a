"""Small result tables as Markdown, and whole evaluation runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.operators import evaluation, ranking, significance
from lexivane.operators.index import Index


def markdown_table(rows: list[tuple], headers: list[str], formats: list[str]) -> str:
    """Rows as a Markdown table; a format is as for ``format``, null is ``N/A``."""
    cell = lambda v, f: "N/A" if v is None else format(v, f)
    lines = ["| " + " | ".join(headers) + " |", "| " + " | ".join("---:" if f else "---" for f in formats) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v, f) for v, f in zip(r, formats, strict=True)) + " |" for r in rows])


def results_table(rows: list[tuple]) -> str:
    """(ranker, parameters, precision, recall, mrr, ndcg, seconds a query)."""
    return markdown_table([(*r[:6], r[6] * 1000) for r in rows], ["Ranker", "Parameters", "Precision@10", "Recall@10", "MRR", "NDCG@10", "ms/query"], ["", "", ".3f", ".3f", ".3f", ".3f", ".3f"])


def grid_report(rows: list[tuple]) -> str:
    """(k1, b, precision, recall, mrr, ndcg)."""
    return markdown_table(rows, ["k1", "b", "Precision@10", "Recall@10", "MRR", "NDCG@10"], [".1f", ".2f", ".3f", ".3f", ".3f", ".3f"])


def recommender_table(rows: list[tuple]) -> str:
    """(strategy, rmse or None, precision, recall)."""
    return markdown_table(rows, ["Strategy", "RMSE", "Precision@10", "Recall@10"], ["", ".3f", ".3f", ".3f"])


def cold_start_table(rows: list[tuple]) -> str:
    return markdown_table(rows, ["History size", "Strategy", "Precision@10"], ["d", "", ".3f"])


def significance_report(c: significance.Comparison) -> str:
    row = (c.n, c.mean_difference, c.t, c.t_p, c.w, c.w_p, f"[{c.interval[0]:.6f}, {c.interval[1]:.6f}]", c.wins_first, c.wins_second, c.ties)
    return markdown_table([row], ["Pairs", "Mean difference", "t", "t p", "W", "W p", "95% CI", "Wins first", "Wins second", "Ties"], ["d", ".6f", ".4f", ".6g", ".4f", ".6g", "", "d", "d", "d"])


def update_section(text: str, marker: str, section: str) -> str:
    """``text`` with all from ``marker`` on replaced by ``section``."""
    kept = text.split(marker)[0].rstrip()
    return (kept + "\n\n" if kept else "") + section.rstrip() + "\n"


def evaluate_rankers(index: Index, queries: DataFrame, qrels: DataFrame, rankers: dict[str, ranking.Ranker], k: int = 10) -> list[tuple]:
    """(name, precision, recall, mrr, ndcg, seconds a labelled query) of each ranker; no labelled query raises."""
    labelled = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    n = labelled.count()
    if n == 0:
        raise ValueError("no labelled queries")
    out = []
    for name, ranker in rankers.items():
        began = time.perf_counter()
        m = evaluation.mean_metrics(ranker.rank(labelled, k), labelled, qrels, k).first()
        out.append((name, m["precision"], m["recall"], m["mrr"], m["ndcg"], (time.perf_counter() - began) / n))
    return out


def run_evaluation(index: Index, queries: DataFrame, qrels: DataFrame, k: int = 10) -> dict:
    """Grid sweep in one job, the best setting, TF-IDF beside it, and their paired comparison."""
    labelled = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    swept = ranking.bm25_grid(index, labelled, k)
    grid = evaluation.mean_metrics(swept, labelled, qrels, k, by=("grid_pos", "k1", "b"))
    points = [tuple(r) for r in grid.orderBy("grid_pos").select("k1", "b", "precision", "recall", "mrr", "ndcg").collect()]
    best = max(points, key=lambda p: p[5])
    rankers = {"TF-IDF": ranking.TfIdf(index), "BM25": ranking.Bm25(index, best[0], best[1])}
    rows = evaluate_rankers(index, labelled, qrels, rankers, k)
    ndcg = {n: evaluation.per_query_ndcg(r.rank(labelled, k), labelled, qrels, k).withColumnRenamed("ndcg", "score") for n, r in rankers.items()}
    compared = significance.compare(ndcg["BM25"], ndcg["TF-IDF"], seed=2026)
    text = "\n\n".join(["# Evaluation", results_table([(n, f"k1={best[0]}, b={best[1]}" if n == "BM25" else "", *m) for n, *m in rows]), "## BM25 grid", grid_report(points), "## Paired comparison", significance_report(compared)])
    return {"grid": points, "best": best[:2], "rankers": rows, "comparison": compared, "report": text}


def average_seconds(run, texts: list[str]) -> float:
    """Mean seconds of ``run`` over query texts."""
    began = time.perf_counter()
    for t in texts:
        run(t)
    return (time.perf_counter() - began) / max(1, len(texts))


def searchable_terms(vocabulary: DataFrame) -> DataFrame:
    """Terms that a Boolean query can name: those that aren't operators."""
    return vocabulary.select("term").where(~F.upper("term").isin("AND", "OR", "NOT"))
