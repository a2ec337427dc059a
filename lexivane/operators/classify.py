"""Multinomial Naive Bayes over labelled texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.tables import numbered
from lexivane.functions.text import tokenize


@dataclass(frozen=True)
class NaiveBayes:
    """``classes``: (label, n_docs, n_tokens); ``terms``: (label, term, cnt); ``vocabulary``: one row, v."""

    classes: DataFrame
    terms: DataFrame
    vocabulary: DataFrame
    alpha: float
    tokenizer: Callable[[Column], Column]

    def probabilities(self, texts: DataFrame) -> DataFrame:
        """(doc_id, label, p) of (doc_id, text), for every class.

        Unsmoothed priors; a term's share is (cnt + alpha) / (tokens + alpha (v + 1)), an
        unknown term counts 0. Every class starts from the score of a text of unknown
        terms; only terms that it knows are joined, and add ln(cnt + alpha) - ln(alpha).
        """
        total = self.classes.agg(F.sum("n_docs").alias("total"))
        # One row a class; the classes of a classifier are few, and checked to be.
        if self.classes.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        priors = self.classes.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(self.vocabulary)).select("label", F.log(F.col("n_docs") / F.col("total")).alias("prior"), F.log(self.alpha / (F.col("n_tokens") + self.alpha * (F.col("v") + 1))).alias("unknown"))
        tokens = texts.select("doc_id", self.tokenizer(F.col("text")).alias("terms"))
        start = tokens.select("doc_id", F.size("terms").alias("n")).crossJoin(F.broadcast(priors)).select("doc_id", "label", (F.col("prior") + F.col("n") * F.col("unknown")).alias("score"))
        each = tokens.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("freq"))
        known = each.join(self.terms, "term").select("doc_id", "label", (F.col("freq") * (F.log(F.col("cnt") + self.alpha) - F.log(F.lit(self.alpha)))).alias("score"))
        scores = start.unionByName(known).groupBy("doc_id", "label").agg(F.sum("score").alias("score"))
        w = Window.partitionBy("doc_id")
        scaled = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
        return scaled.select("doc_id", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))

    def predict(self, texts: DataFrame) -> DataFrame:
        """(doc_id, predicted): the likeliest label, the least on ties."""
        best = F.max_by(F.col("label"), F.struct(F.round("p", 12), -F.col("label")))
        return self.probabilities(texts).groupBy("doc_id").agg(best.alias("predicted"))

    def top_words(self, n: int = 10, classes: int | None = None) -> DataFrame:
        """(label, rank, term, cnt): each class's most frequent terms, ties by term.

        With ``classes``, of so many classes with the most documents, ties by label.
        """
        order = Window.partitionBy("label").orderBy(F.desc("cnt"), "term")
        terms = self.terms
        if classes is not None:
            largest = self.classes.orderBy(F.desc("n_docs"), "label").limit(classes).select("label")
            terms = terms.join(F.broadcast(largest), "label", "left_semi")
        return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


MAX_CLASSES = 10_000


def fit(texts: DataFrame, alpha: float = 1.0, tokenizer: Callable[[Column], Column] = tokenize) -> NaiveBayes:
    """Fit to (text, label). Without rows it raises."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    if texts.isEmpty():
        raise ValueError("no training texts")
    rows = texts.select("label", tokenizer(F.col("text")).alias("terms"))
    classes = rows.groupBy("label").agg(F.count("*").alias("n_docs"), F.sum(F.size("terms")).alias("n_tokens"))
    terms = rows.select("label", F.explode("terms").alias("term")).groupBy("label", "term").agg(F.count("*").alias("cnt"))
    return NaiveBayes(classes, terms, terms.agg(F.count_distinct("term").alias("v")), alpha, tokenizer)


def split(rows: DataFrame, fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, testing) of rows with a ``doc_id``: a share, rounded half to even, at least one, is held out.

    Which ones, the order of MD5 digests of seed and id decides.
    """
    placed = numbered(rows.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), "doc_id"))), "_draw", "doc_id").drop("_draw")
    held = max(1, round(placed.count() * fraction))
    return placed.where(F.col("place") > held).drop("place"), placed.where(F.col("place") <= held).drop("place")


def majority(labels: DataFrame) -> DataFrame:
    """(label, n): the most frequent label, the least on ties."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)


def accuracy(predicted: DataFrame, actual: DataFrame, training_labels: DataFrame) -> DataFrame:
    """One row: accuracy, and that of always answering the training data's majority label."""
    rows = predicted.join(actual, "doc_id").crossJoin(F.broadcast(majority(training_labels).select(F.col("label").alias("most"))))
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(share(F.col("predicted") == F.col("label")).alias("accuracy"), share(F.col("most") == F.col("label")).alias("majority_accuracy"))
