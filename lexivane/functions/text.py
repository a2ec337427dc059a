"""Text to terms, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the term definition.
STOPWORDS = ("a", "an", "and", "in", "of", "the", "to")
DIACRITICS = r"[\x{064B}-\x{0652}\x{0670}]"
FOLD_FROM = "أإآٱى٠١٢٣٤٥٦٧٨٩ـ"
FOLD_TO = "ااااي0123456789"
#: The range of all characters that folding changes.
FOLDED = r"[\x{0622}-\x{0671}]"
TERM = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Drop Arabic marks and tatweel, unify letter forms and digits, lower-case.

    Texts without a character of that range, found by one scan, skip the folding.
    """
    folded = F.translate(F.regexp_replace(text, DIACRITICS, ""), FOLD_FROM, FOLD_TO)
    return F.lower(F.when(text.rlike(FOLDED), folded).otherwise(text))


def tokenize(text: Column, stopwords: Iterable[str] | None = None) -> Column:
    """Terms of a text in order, as an array; a null text has none.

    A given list replaces the default stop words; it is lower-cased, not folded.
    """
    drop = [w.lower() for w in (STOPWORDS if stopwords is None else stopwords)]
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(drop)) if drop else found


def tokenizer(stopwords: Iterable[str] | None = None) -> Callable[[Column], Column]:
    """``tokenize`` with a stop-word list bound: what index builders take."""
    words = None if stopwords is None else tuple(stopwords)
    return lambda text: tokenize(text, words)


def tokenize_text(text: str, stopwords: Iterable[str] | None = None) -> list[str]:
    """The same terms of one string on the driver, for query texts."""
    import re

    drop = {w.lower() for w in (STOPWORDS if stopwords is None else stopwords)}
    marks = {c: None for c in [*range(0x064B, 0x0653), 0x0670]}
    letters = {ord(a): b for a, b in zip(FOLD_FROM, [*FOLD_TO, None], strict=True)}
    return [t for t in re.findall(r"[^\W_]+", text.translate(marks).translate(letters).lower()) if t not in drop]


def indexed_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit(" "), body)
