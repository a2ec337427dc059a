"""Whole runs with their reports: index benchmark, ranker comparison, recommender evaluation."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions.tables import cut, new_folder
from lexivane.operators import boolean, classify, cluster, evaluation, factorization, prefix, ranking, recommend, significance, synthetic, vectors
from lexivane.operators.index import Index, build_index, store
from lexivane.plans import charts, reports

#: Fixed values of the runs.
SEED, SMALL_CORPUS, TOPICS, TOPIC_ROUNDS = 2026, 1_000, 20, 20
SETTINGS = factorization.Settings(n_factors=24, rate=0.015, reg=0.03, epochs=12, batch=512)


def write_section(path: str, marker: str, section: str) -> None:
    """Put a section into a report file, in place of all from its marker on."""
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    with open(path, "w", encoding="utf-8") as f:
        f.write(reports.update_section(text, marker, f"{marker}\n\n{section}"))


# --- index and look-ups ---


@dataclass(frozen=True)
class Measurements:
    """Seconds: of builds, a query of each kind, the vocabulary, and a prefix look-up."""

    documents: int
    runs: int
    build_small: float
    build_all: float
    queries: dict[str, float]
    vocabulary: float
    prefix: str
    prefix_lookup: float

    def report(self) -> str:
        rows = [(f"Index build ({SMALL_CORPUS:,} documents)", self.build_small), (f"Index build ({self.documents:,} documents)", self.build_all)]
        rows += [(f"{name} query", s) for name, s in self.queries.items()]
        rows += [("Vocabulary", self.vocabulary), (f"Prefix look-up (`{self.prefix}`)", self.prefix_lookup)]
        head = f"{self.documents:,} documents; queries are means of {self.runs} runs."
        return f"{head}\n\n{reports.markdown_table(rows, ['Operation', 'Seconds'], ['', '.4f'])}"


def _timed(run: Callable[[], object]) -> tuple[float, object]:
    began = time.perf_counter()
    out = run()
    return time.perf_counter() - began, out


def run_benchmarks(documents: DataFrame, runs: int = 100) -> Measurements:
    """Build an index of (doc_id, title, body), written, and time look-ups of its first four terms."""
    if runs < 1:
        raise ValueError("a mean needs a run")
    spark, n = documents.sparkSession, documents.count()
    if n < SMALL_CORPUS:
        raise ValueError(f"the corpus must have {SMALL_CORPUS:,} documents or more")
    small, _ = _timed(lambda: store(build_index(documents.limit(SMALL_CORPUS)), new_folder(spark, "bench-small")))
    whole, index = _timed(lambda: store(build_index(documents), new_folder(spark, "bench")))
    terms = [r["term"] for r in reports.searchable_terms(index.term_stats).orderBy("term").limit(4).collect()]
    if len(terms) < 4:
        raise ValueError("the corpus must have four terms that a query can name")
    a, b, c, d = terms
    texts = {"single term": a, "AND": f"{a} AND {b}", "OR": f"{a} OR {b}", "NOT": f"NOT {a}", "nested": f"(({a} AND {b}) OR ({c} AND NOT {d}))"}
    queries = {name: reports.average_seconds(lambda t: boolean.search(index, t), [t] * runs) for name, t in texts.items()}
    vocabulary, start = _timed(lambda: prefix.common_prefix(index.term_stats))
    lookup = reports.average_seconds(lambda p: prefix.with_prefix(index.term_stats, p).collect(), [start] * runs)
    return Measurements(n, runs, small, whole, queries, vocabulary, start, lookup)


# --- BM25 against TF-IDF ---


def run_significance(index: Index, queries: DataFrame, qrels: DataFrame, path: str | None = None, k1: float = 1.2, b: float = 0.75, k: int = 10) -> significance.Comparison:
    """Paired comparison of the two rankers by NDCG; with a ``path`` its section goes into that report."""
    rankers = ranking.Bm25(index, k1, b), ranking.TfIdf(index)
    scores = [evaluation.per_query_ndcg(r.rank(queries, k), queries, qrels, k).withColumnRenamed("ndcg", "score") for r in rankers]
    found = significance.compare(*scores, seed=SEED)
    if path:
        write_section(path, "## Paired comparison", reports.significance_report(found))
    return found


def run_evaluation(index: Index, queries: DataFrame, qrels: DataFrame, folder: str, k: int = 10) -> dict:
    """``reports.run_evaluation`` with its report, results and heat map written to ``folder``."""
    found = reports.run_evaluation(index, queries, qrels, k)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "evaluation.md"), "w", encoding="utf-8") as f:
        f.write(found["report"] + "\n")
    charts.save(os.path.join(folder, "bm25-grid.svg"), charts.heat_map({(p[0], p[1]): p[5] for p in found["grid"]}, "k1", "b", "NDCG@10"))
    return found


# --- recommenders ---


def run_recommenders(index: Index, folder: str | None = None, seed: int = SEED, users: int = 1_000, ratings: int = 40, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS, settings: factorization.Settings = SETTINGS, k: int = 10, sizes=(0, 1, 3, 5, 20)) -> dict:
    """From an index to topics, a topic classifier, synthetic ratings, models and cold-start figures.

    Gives ``strategies`` (strategy, rmse, precision, recall), ``cold_start`` (history size,
    strategy, precision), ``topic_accuracy``, ``majority_accuracy``, ``training_accuracy``,
    ``topic_words`` of the three largest topics, ``losses``, ``validation_losses`` and the
    ``report``; with a ``folder`` the report and its charts are written there.
    """
    documents = index.docs.select("doc_id")
    weights = cut(vectors.document_vectors(index))
    assigned = cut(cluster.spherical_kmeans(weights, documents, topics, rounds, seed)[0])
    aligned = recommend.align_topics(documents, assigned)
    texts = index.docs.join(aligned, "doc_id").select("doc_id", F.col("terms").alias("text"), F.col("topic").alias("label"))
    training_texts, testing_texts = classify.split(texts, 0.2, seed + 7)
    # Documents of an index are terms already.
    classifier = classify.fit(training_texts.select("text", "label"), tokenizer=lambda c: c)
    scored = {}
    for name, rows in (("training", training_texts), ("testing", testing_texts)):
        scored[name] = classify.accuracy(classifier.predict(rows.select("doc_id", "text")), rows.select("doc_id", "label"), training_texts.select("label")).first()
    words: dict[int, list] = {}
    for r in classifier.top_words(k, classes=3).orderBy("label", "rank").collect():
        words.setdefault(r["label"], []).append((r["term"], r["cnt"]))

    rated, _ = synthetic.synthetic_ratings(documents.sparkSession, aligned, users, ratings, seed + 1)
    training, testing = (cut(x) for x in recommend.split_by_user(cut(rated), seed=seed + 2))
    item_ids = [r["doc_id"] for r in documents.toLocalIterator()]
    user_ids = [r["user_id"] for r in rated.select("user_id").distinct().toLocalIterator()]

    def fit(interactions: DataFrame, own: int, validation: DataFrame | None = None) -> factorization.Model:
        return factorization.fit(interactions, replace(settings, seed=own), user_ids, item_ids, validation)

    curve = fit(training, seed + 3, testing)
    compared = recommend.compare_strategies(training, testing, documents, fit(training, seed + 4), k, seed + 5).orderBy("strategy").collect()
    cold = recommend.cold_start(weights, documents, training, testing, fit, sizes, seed + 6, k).collect()
    out = {
        "strategies": [tuple(r) for r in compared],
        "cold_start": [tuple(r) for r in cold],
        "topic_accuracy": scored["testing"]["accuracy"],
        "majority_accuracy": scored["testing"]["majority_accuracy"],
        "training_accuracy": scored["training"]["accuracy"],
        "topic_words": words,
        "losses": curve.losses,
        "validation_losses": curve.validation_losses,
    }
    out["report"] = _recommender_report(out, users, len(item_ids))
    if folder:
        os.makedirs(folder, exist_ok=True)
        write_section(os.path.join(folder, "recommenders.md"), "## Recommenders on synthetic ratings", out["report"])
        charts.save(os.path.join(folder, "loss.svg"), charts.lines({"training": list(enumerate(curve.losses, 1)), "test": list(enumerate(curve.validation_losses, 1))}, "epoch", "loss"))
        by: dict[str, list] = {}
        for size, strategy, precision in out["cold_start"]:
            by.setdefault(strategy, []).append((size, precision))
        charts.save(os.path.join(folder, "cold-start.svg"), charts.lines(by, "history size", "Precision@10"))
    return out


def _recommender_report(found: dict, users: int, documents: int) -> str:
    topics = [(t, ", ".join(f"{w} ({n})" for w, n in own)) for t, own in found["topic_words"].items()]
    return "\n\n".join(
        [
            f"Ratings of {users:,} generated users on {documents:,} documents, by fixed seeds; they test the code, not anyone's taste.",
            reports.recommender_table(found["strategies"]),
            "### Short histories",
            reports.cold_start_table(found["cold_start"]),
            "### Topics",
            f"Accuracy on held-out documents {found['topic_accuracy']:.3f}, of the majority topic {found['majority_accuracy']:.3f}, on training documents {found['training_accuracy']:.3f}.",
            reports.markdown_table(topics, ["Topic", "Most frequent words"], ["d", ""]),
        ]
    )
