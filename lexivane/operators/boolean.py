"""Boolean keyword queries: text to a predicate over a document's terms.

NOT binds tighter than AND, AND tighter than OR; NOT after an operand means AND NOT.
The parsed query becomes one Column, so Catalyst simplifies it and a search is one
scan with one filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions.text import tokenize_text
from lexivane.operators.index import Index, StoredIndex


class QueryParseError(ValueError):
    """A query that isn't well formed."""


_STRENGTH = {"OR": 1, "AND": 2, "NOT": 3}


def lex(query: str, tokenizer: Callable[[str], list[str]] = tokenize_text) -> list[tuple[str, str]]:
    """(kind, text) of each part; kinds are the operators, the parentheses, and TERM.

    A word that isn't an operator is tokenized like a document and may give none, one or
    several terms.
    """
    out = []
    for word in re.findall(r"[()]|[^\s()]+", query):
        if word in "()":
            out.append((word, word))
        elif word.upper() in _STRENGTH:
            out.append((word.upper(), word.upper()))
        else:
            out += [("TERM", t) for t in tokenizer(word)]
    return out


def parse(query: str, tokenizer: Callable[[str], list[str]] = tokenize_text):
    """The query as nested tuples: ("TERM", t), ("NOT", x), ("AND", x, y), ("OR", x, y).

    Precedence climbing: ``climb(level)`` reads an operand, then every operator that
    binds at least as strongly as ``level``.
    """
    parts = lex(query, tokenizer)
    if not parts:
        raise QueryParseError("empty query")
    end = ("END", "")
    at = 0

    def kind() -> str:
        return (parts[at] if at < len(parts) else end)[0]

    def operand(operator: str | None):
        nonlocal at
        found = kind()
        if operator and (found in ("END", ")") or found in ("AND", "OR")):
            raise QueryParseError(f"missing right operand for {operator}")
        if found == "END":
            raise QueryParseError("missing operand")
        if found in ("AND", "OR"):
            raise QueryParseError(f"missing left operand for {found}")
        if found == ")":
            raise QueryParseError("unbalanced parentheses")
        at += 1
        if found == "NOT":
            return ("NOT", operand("NOT"))
        if found == "TERM":
            return parts[at - 1]
        if kind() == ")":
            raise QueryParseError("missing operand inside parentheses")
        inner = climb(1, None)
        if kind() != ")":
            raise QueryParseError("unbalanced parentheses")
        at += 1
        return inner

    def climb(level: int, operator: str | None):
        nonlocal at
        left = operand(operator)
        while True:
            found = "AND" if kind() == "NOT" else kind()  # an operand may be followed by NOT alone
            if found not in ("AND", "OR") or _STRENGTH[found] < level:
                return left
            if kind() != "NOT":
                at += 1
            left = (found, left, climb(_STRENGTH[found] + 1, found))

    tree = climb(1, None)
    if at < len(parts):
        raise QueryParseError("unbalanced parentheses" if kind() == ")" else f"unexpected token {parts[at][1]!r}")
    return tree


def predicate(tree, terms: Column) -> Column:
    """The parsed query as a condition on an array of terms."""
    kind, *rest = tree
    if kind == "TERM":
        return F.array_contains(terms, rest[0])
    parts = [predicate(x, terms) for x in rest]
    return ~parts[0] if kind == "NOT" else parts[0] & parts[1] if kind == "AND" else parts[0] | parts[1]


def leaves(tree) -> list[str]:
    """The different terms of a parsed query."""
    kind, *rest = tree
    return [rest[0]] if kind == "TERM" else list(dict.fromkeys(t for x in rest for t in leaves(x)))


def holds(tree, has) -> Column | bool:
    """The parsed query over ``has(term)``."""
    kind, *rest = tree
    if kind == "TERM":
        return has(rest[0])
    parts = [holds(x, has) for x in rest]
    if kind == "NOT":
        return (not parts[0]) if isinstance(parts[0], bool) else ~parts[0]
    return parts[0] & parts[1] if kind == "AND" else parts[0] | parts[1]


def _by_postings(index: StoredIndex, tree) -> DataFrame:
    """Reads the postings of the query's terms only, and all ids only if a document without any can match."""
    terms = leaves(tree)
    flag = {t: f"t{i}" for i, t in enumerate(terms)}
    found = index.postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(c) for t, c in flag.items()])
    if holds(tree, lambda t: False):
        found = index.doc_stats.select("doc_id").join(found, "doc_id", "left").na.fill(False)
    return found.where(holds(tree, lambda t: F.col(flag[t]))).select("doc_id")


def matching(index: Index, query: str, tokenizer: Callable[[str], list[str]] = tokenize_text) -> DataFrame:
    """Ids of the documents that match; NOT ranges over all documents, empty ones too."""
    if isinstance(index, StoredIndex):
        return _by_postings(index, parse(query, tokenizer))
    return index.docs.where(predicate(parse(query, tokenizer), F.col("terms"))).select("doc_id")


def search(index: Index, query: str, tokenizer: Callable[[str], list[str]] = tokenize_text) -> list[str]:
    return [r["doc_id"] for r in matching(index, query, tokenizer).orderBy("doc_id").collect()]


# The same operations on sets of ids, for results that are already tables.


def and_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def or_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def not_ids(a: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(a, "doc_id", "left_anti")
