"""Benchmark decontamination: a broadcast set of benchmark n-grams, scanned for in every text.

Every window of 13 words of the benchmark items (an item of fewer words is one window)
is a polynomial hash in a sorted array that each executor gets. A text's words become
numbers, its windows' hashes a few vector operations over a batch; a hash that is in
the array is verified against the words themselves. The array is cut into blocks of
bounded size: one block goes out with one scan, further blocks take further scans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import column_or_null, written

WIDTH = 13
#: Windows in one broadcast block, some 200 bytes each.
BLOCK_WINDOWS = 100_000
#: And so many bytes for each, which only very long words reach.
WINDOW_BYTES = 400
#: ASCII letters to lower case, other ASCII but digits to a space; the rest stays.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of digits, letters and non-ASCII."""
    return (text or b"").translate(TABLE).split()


class Windows:
    """A block of benchmark windows, ready to be looked up."""

    def __init__(self, windows: dict[bytes, list]):
        self.items = windows
        self.ids: dict[bytes, int] = {}
        by_length = defaultdict(list)
        for gram in windows:
            w = gram.split(b" ")
            by_length[len(w)].append([self.ids.setdefault(x, len(self.ids) + 1) for x in w])
        self.hashes = {n: np.unique(rolling(np.array(w, dtype=np.uint64).T)) for n, w in by_length.items()}

    def hits(self, words: list[bytes]):
        """(start, length, items) of the windows that occur, verified."""
        numbers = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        unknown = np.concatenate([[-1], np.flatnonzero(numbers == 0), [len(words)]])
        longest = int(np.diff(unknown).max()) - 1
        for n, known in self.hashes.items():
            if longest < n:
                continue
            h = rolling([numbers[i : len(numbers) - n + 1 + i] for i in range(n)])
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == h).tolist():
                found = self.items.get(b" ".join(words[i : i + n]))
                if found is not None:
                    yield i, n, found


def rolling(columns) -> np.ndarray:
    """Hashes of windows given by their columns of word numbers; wraps at 64 bits."""
    out = None
    with np.errstate(over="ignore"):
        for c in columns:
            c = np.asarray(c, dtype=np.uint64)
            out = c + np.uint64(1) if out is None else out * np.uint64(_BASE) + c
            out = out ^ (out >> np.uint64(29))
    return out


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, owners = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = words_of(text)
                if w:
                    for g in {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}:
                        grams.append(g)
                        owners.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(owners, pa.string())], ["gram", "item"])

    return run


def _found(known: Windows, texts: list) -> tuple[list, list, list]:
    """Of each text: its number of words, its runs of hit words, its items."""
    n_words, runs, items = [], [], []
    for text in texts:
        words, hit, got = words_of(text), None, set()
        for i, n, found in known.hits(words):
            if hit is None:
                hit = np.zeros(len(words) + 2, dtype=np.int8)
            hit[i + 1 : i + 1 + n] = 1
            got.update(found)
        change = [] if hit is None else np.flatnonzero(np.diff(hit)).tolist()
        n_words.append(len(words))
        runs.append([{"start": a, "end": b} for a, b in zip(change[::2], change[1::2], strict=True)])
        items.append(sorted(got))
    return n_words, runs, items


def _scan(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(block.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_words, runs, items = _found(known, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))], ["key", "n_words", "runs", "items"])

    return run


SCHEMA = "key {key}, n_words long, runs array<struct<start:long,end:long>>, items array<string>"


def _blocks(benchmark: DataFrame, width: int, limit: int) -> tuple[int, Iterator[dict[bytes, list[str]]]]:
    """How many blocks, and the benchmark's windows in them, each a dict words -> items.

    A block holds about ``limit`` (window, item) pairs, or ``limit * WINDOW_BYTES`` bytes
    if that is reached first. Pairs go to blocks by their hash: a window that very many
    items share stands in several blocks, each with some of the items.
    """
    items = benchmark.select(F.coalesce(column_or_null(benchmark, "item_id", "string"), F.lit("")), column_or_null(benchmark, "text", "string"))
    pairs = written(items.mapInArrow(_item_windows(width), "gram binary, item string").distinct(), "decontam-windows")
    size = pairs.agg(F.count("*").alias("n"), F.sum(F.length("gram") + F.octet_length("item")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // limit), -(-(size["bytes"] or 0) // (limit * WINDOW_BYTES)))

    def block(k: int) -> dict[bytes, list[str]]:
        out = defaultdict(list)
        chosen = pairs.where(F.pmod(F.xxhash64("gram", "item"), F.lit(parts)) == k) if parts > 1 else pairs
        for r in chosen.toLocalIterator():
            out[bytes(r["gram"])].append(r["item"])
        return dict(out)

    return parts, (block(k) for k in range(parts))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """(key, n_words, runs, items) of every row of (key, text).

    ``runs`` are the hit words as [start, end) word positions, disjoint and ascending;
    ``items`` the items with an occurring window, sorted as strings. Null and empty texts
    have no words and no hits; an item without words has no window; equal items and
    repeated rows are each reported. A benchmark above ``limit`` windows takes a scan of
    the texts for each block; rows with hits are then merged by the hash of their text,
    of which hits are a function.
    """
    parts, blocks = _blocks(benchmark, width, limit)
    if parts == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(blocks))
        return docs.select("key", "text").mapInArrow(_scan(sent), SCHEMA.format(key=docs.schema["key"].dataType.simpleString()))
    return docs.select("key", text_hash().alias("h")).join(_hits_by_text(docs, blocks), "h").select("key", "n_words", "runs", "items")


def text_hash():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _hits_by_text(docs: DataFrame, blocks) -> DataFrame:
    """(h, n_words, runs, items) of every different text, from a scan for each block.

    One block at a time is out: sent, scanned for, and taken back.
    """
    texts, hits = docs.select(text_hash().alias("key"), "text"), None
    for block in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(block)
        part = written(texts.mapInArrow(_scan(sent), SCHEMA.format(key="string")).distinct(), "decontam-block")
        sent.destroy()
        hits = part if hits is None else hits.unionByName(part)
    joined = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  one entry of each block
    merged = hits.groupBy(F.col("key").alias("h")).agg(F.first("n_words").alias("n_words"), merge_runs(F.array_sort(joined("runs"))).alias("runs"), F.array_sort(F.array_distinct(joined("items"))).alias("items"))
    return written(merged, "decontam-merged")


def merge_runs(runs):
    """Union of ascending runs as disjoint ones."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    last = lambda a: F.get(a, F.size(a) - 1)
    step = lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(runs, empty, step)


def n_hit():
    return F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def is_contaminated():
    """A hit, and a twentieth of the words or more hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _cut_words(text: bytes, runs) -> bytes:
    """``text`` without the words of the runs and what stands between them."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(TABLE))]
    out, at = [], 0
    for r in runs:
        a, b = places[r["start"]][0], places[r["end"] - 1][1]
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _clean(block, names: list[str], with_length: bool):
    """Drops contaminated rows, cuts hit words out of the others.

    Without a block the runs come with the rows, in two more columns at the end.
    """
    text_at, length_at = names.index("text"), names.index("n_chars") if with_length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(block.value) if block else None
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            n_words, runs = _found(known, texts)[:2] if known else (batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())
            hit = [sum(r["end"] - r["start"] for r in x) for x in runs]
            keep = pa.array([not (h and 20 * h >= n) for h, n in zip(hit, n_words, strict=True)], pa.bool_())
            columns = list(batch.columns[: len(names)])
            if any(hit):
                new = [_cut_words(t, r) if r else t for t, r in zip(texts, runs, strict=True)]
                columns[text_at] = pa.array(new, pa.binary()).cast(columns[text_at].type)
                if length_at is not None:
                    old = columns[length_at]
                    columns[length_at] = pa.array([len(t.decode("utf-8", "replace")) if r else n for t, r, n in zip(new, runs, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, and without hit words in the others.

    A document with a twentieth of its words inside benchmark windows goes; of one with
    fewer, the hit words are cut out, and ``n_chars`` follows where there is such a
    column. Other columns may have any name. A benchmark of one block takes one map over the documents; a larger one
    takes a scan for each block and a join on the hash of the text.
    """
    names = docs.columns
    with_length = "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")
    parts, blocks = _blocks(benchmark, width, limit)
    if parts == 1:
        return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(next(blocks)), names, with_length), docs.schema)
    found = _hits_by_text(docs, blocks).select("h", F.col("n_words").alias("n"), F.col("runs").alias("r"))
    # The table's own columns travel in a struct, whatever their names are.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_hash().alias("h")).join(found, "h").select(*[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "n", "r")
    return rows.mapInArrow(_clean(None, names, with_length), docs.schema)
