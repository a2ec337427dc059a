"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import WORD, bind

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine einen ist mit nicht sich und von zu als auf "
    "au aux dans de des du elle en est et il la le les par pas pour que qui un une "
    "con del el los las lo no por se su y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= numerator / denominator <= high``.

    Both are names of metrics. Limits are fractions ``(n, d)``, so that the test is
    one of integers and no rounding can change a verdict. A zero denominator passes.
    """

    name: str
    numerator: str
    denominator: str
    low: tuple[int, int] | None = None
    high: tuple[int, int] | None = None


#: The production table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=(2, 1), high=(15, 1)),
    Rule("symbols_to_words", "n_symbols", "n_words", high=(1, 10)),
    Rule("capitals_to_characters", "n_capitals", "word_chars", high=(1, 2)),
    Rule("stop_words_to_words", "n_stop_words", "n_words", low=(1, 50)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=(1, 2)),
    Rule("repeated_words", "n_repeat_words", "n_words", high=(1, 2)),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=(9, 10)),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=(3, 10)),
)

_CAPITALS = "[A-ZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ]"
_SYMBOLS = "[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Windows are compared by their 64-bit hash. A text without an equal pair, the usual
    case, ends after one set lookup a word; the others sort (hash, position) pairs,
    so the cost stays n log n however often a window repeats.
    """

    def hashes(w):
        n = F.size(w)
        return F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def repeated(g):
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(pairs, lambda p: bind(positions(p), covered))

    def positions(p):
        same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
        marked = F.transform(p, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def covered(s):
        step = F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    zero = F.lit(0).cast("long")
    return bind(words, lambda w: bind(hashes(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(repeated(g))))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``_row``, and beside it every metric of the rule table.

    Words and lines are split once, in an inner projection that Catalyst keeps apart as
    several metrics read them. A null text is an empty one.
    """
    t = F.coalesce(F.col("_row.text"), F.lit(""))
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row",
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    w, x = F.col("_words"), F.col("_lines")
    some = lambda test: F.size(F.filter(x, test)).cast("long")
    return split.select(
        "_row",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit(_CAPITALS)).cast("long").alias("n_capitals"),
        F.size(F.filter(w, lambda v: v.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        some(lambda v: v.rlike(r"^[\x20\x09]*[-*•]")).alias("n_bullet_lines"),
        some(lambda v: v.endswith("...") | v.endswith("…")).alias("n_ellipsis_lines"),
    )


def verdict(rules=RULES) -> Column:
    """The rule table as one boolean expression over the metric columns."""
    ok = F.lit(True)
    for r in rules:
        n, d = F.col(r.numerator), F.col(r.denominator)
        if r.low:
            ok = ok & ((d == 0) | (n * r.low[1] >= d * r.low[0]))
        if r.high:
            ok = ok & ((d == 0) | (n * r.high[1] <= d * r.high[0]))
    return ok


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, keep_columns=("doc_id",)) -> DataFrame:
    """One row per document: its kept columns, every metric, ``base_failed``, ``kept``.

    A map-only projection of built-in functions: no shuffle, no Python, one pass.
    Null text counts as empty: all metrics 0, ``base_failed`` true. Repeated rows and
    null ids each keep their own row. An empty table gives no rows.
    """
    found = measured(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return found.select(*[F.col(f"_row.`{c}`") for c in keep_columns], *found.columns[1:])


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that pass every rule, with the table's own columns and nothing else.

    Input columns travel inside one struct, so columns named like metrics are safe.
    """
    return measured(docs).where(~base_failed() & verdict(rules)).select("_row.*")
