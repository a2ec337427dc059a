"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features; each step fits a tree of three leaves to one feature's
binned residuals and adds it to that feature's lookup table. Then the pairs of features
whose residuals interact most get tables of their own. A score is a sum of table cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm import rules
from lexivane.llm.common import written

#: The model is fitted on so many different labelled rows at most, drawn by hash.
TRAIN_ROWS = 30_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS = 32, 8, 120, 60, 6
RATE, RIDGE = 0.15, 5.0
THRESHOLD = 0.3


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each text: counts and ratios, built-in functions only."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    t = F.coalesce(F.col("_row.text"), F.lit(""))
    found = rules.measured(docs).withColumn("n_chars_", F.length(t)).withColumn("n_bytes_", F.octet_length(t))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.log1p("n_words").alias("log_words"),
        ratio("word_chars", "n_words").alias("word_length"),
        ratio("n_symbols", "n_words").alias("symbols"),
        ratio("n_capitals", "word_chars").alias("capitals"),
        ratio("n_stop_words", "n_words").alias("stop_words"),
        ratio("n_repeat_words", "n_words").alias("repeats"),
        ratio("n_dup_lines", "n_lines").alias("dup_lines"),
        ratio("n_words", "n_lines").alias("line_words"),
        ratio("n_bullet_lines", "n_lines").alias("bullets"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipses"),
        ratio("n_bytes_", "n_chars_").alias("char_bytes"),
    )


NAMES = ("log_words", "word_length", "symbols", "capitals", "stop_words", "repeats", "dup_lines", "line_words", "bullets", "ellipses", "char_bytes")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step for each bin: the best tree of up to three leaves over ordered bins."""
    values = np.zeros(len(g))
    parts = [(0, len(g))]
    gain_of = lambda a, b: np.square(a) / (b + RIDGE)
    for _ in range(2):
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gain_of(gl, hl) + gain_of(gt - gl, ht - hl) - gain_of(gt, ht)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (k, a + i + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return values


def four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a grid into four quarters."""
    size = len(g)
    cg, ch = (np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (g, h))
    a, b = np.arange(size - 1)[:, None], np.arange(size - 1)[None, :]
    last = size - 1
    corner = lambda c: [c[a, b], c[a, last] - c[a, b], c[last, b] - c[a, b], c[last, last] - c[a, last] - c[last, b] + c[a, b]]
    gs, hs = corner(cg), corner(ch)
    gain = sum(np.square(x) / (y + RIDGE) for x, y in zip(gs, hs, strict=True)) - np.square(cg[-1, -1]) / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = np.zeros_like(g)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs, strict=True):
        steps[rows, cols] = x[i, j] / (y[i, j] + RIDGE)
    return float(gain[i, j]), steps


@dataclass
class Model:
    """Intercept, cut points and table of each feature, and tables of pairs."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``: a bin lookup and an addition for every table."""
        out = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="right") for p in self.pairs for j in p[:2]}
        for i, j, table in self.pairs:
            out += table[coarse[i], coarse[j]]
        return sigmoid(out)


def _cut_points(x: np.ndarray, bins: int, times: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], weights=times, method="inverted_cdf"))


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> Model:
    """Fit to labels 0 and 1, each row counted so many times. One class, or none, gives a constant score."""
    t = np.ones(len(y)) if times is None else times
    share = ((t * y).sum() + 1.0) / (t.sum() + 2.0)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [_cut_points(c, BINS, t) for c in x.T]
    model.pair_cuts = [_cut_points(c, PAIR_BINS, t) for c in x.T]
    fine = [np.searchsorted(c, v, side="right") for c, v in zip(model.cuts, x.T, strict=True)]
    coarse = [np.searchsorted(c, v, side="right") for c, v in zip(model.pair_cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    out = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, bins in enumerate(fine):
            p = sigmoid(out)
            n = len(model.tables[j])
            step = RATE * three_leaves(np.bincount(bins, t * (y - p), n), np.bincount(bins, t * p * (1 - p), n))
            model.tables[j] += step
            out += step[bins]

    def grids(i, j):
        p = sigmoid(out)
        at = coarse[i] * PAIR_BINS + coarse[j]
        return [np.bincount(at, v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS) for v in (t * (y - p), t * p * (1 - p))]

    ranked = sorted(((four_leaves(*grids(i, j))[0], i, j) for i in range(len(fine)) for j in range(i)), reverse=True)
    tables = {(i, j): np.zeros((PAIR_BINS, PAIR_BINS)) for _, i, j in ranked[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in tables.items():
            step = RATE * four_leaves(*grids(i, j))[1]
            table += step
            out += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def held_out(doc_id="doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def train(found: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit to the features of labelled documents that aren't held out.

    Labels other than 0 and 1, and null ones, are left out; a document labelled more than
    once counts each time. At most ``rows`` different rows come to the driver.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    joined = found.join(usable, "doc_id").select("quality", "doc_id", *NAMES)
    # Ids may repeat in both tables: equal rows are counted, and what is left is drawn by its hash.
    equal = written(joined.groupBy("quality", "doc_id", *NAMES).agg(F.count("*").alias("times")), "quality-labelled")
    draw = F.xxhash64(F.lit("train"), "doc_id", "quality", *NAMES)
    data = equal.orderBy(draw, "doc_id", "quality").limit(rows).toPandas().sort_values(["doc_id", "quality", *NAMES])
    return fit(data[list(NAMES)].to_numpy(dtype=float), data["quality"].to_numpy(dtype=float), data["times"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of (doc_id, text).

    Texts are read once, for features; training joins labels to those. Null and empty
    texts score like any other; rows with a null id aren't held out and never train;
    repeated rows keep their own row; without labels every score is one half.
    """
    found = written(features(docs), "quality-features")
    model = train(found, labels)
    scored = found.mapInArrow(_scorer(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
