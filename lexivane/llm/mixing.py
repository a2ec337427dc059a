"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is 1.7 times its size takes every document 1.7 times in
expectation: once for certain, and once more with probability 0.7. Pivotal rounding
settles these fractions in pairs: it moves word mass between two fractional documents
at random, without bias, until one of them is 0 or 1. The mass of a pair never
changes, so a source's taken words miss its target by one small document at most.

Documents are taken in blocks of bounded size (a hot source has many blocks), each
block leaves one fractional document, and a tree of further rounds combines those.
Inside a block documents go from long to short: the long ones settle against the many
shorter ones after them, and what is left over is small.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.tables import numbered
from lexivane.llm.common import column_or_null, word_count, written

#: Rows of a block of the first round, on average, and residuals of a block of the later ones.
BLOCK_ROWS, FAN_IN = 2_000, 64
#: The weights that the sources get in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target is this many times its source's size at most.
MAX_REPEATS = 3
#: Equal rows that are numbered at once.
PART_ROWS = 65_536
#: Up to so many sources are sent to every executor; beyond, they are joined.
BROADCAST_SOURCES = 20_000


def round_pairs(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after settling pairs along the order given: 0 or 1, but for one at most.

    Moves ``size * p`` between two documents; each keeps its expectation, the sum of
    ``size * p`` stays as it is.
    """
    out, draws = p.astype(float).tolist(), rng.random(len(p)).tolist()
    sizes = size.astype(float).tolist()
    held, mass = -1, 0.0
    for j, (b, q) in enumerate(zip(sizes, out, strict=True)):
        if not 0.0 < q < 1.0:
            continue
        if held < 0:
            held, mass = j, b * q
            continue
        a, y = sizes[held], b * q
        up, down = min(a - mass, y), min(mass, b - y)
        if draws[j] * (up + down) < down:
            mass, y, full, spent = mass + up, y - up, a - mass <= y, a - mass >= y
            out[held], out[j] = (1.0 if full else mass / a), (0.0 if spent else y / b)
        else:
            mass, y, spent, full = mass - down, y + down, mass <= b - y, mass >= b - y
            out[held], out[j] = (0.0 if spent else mass / a), (1.0 if full else y / b)
        if not 0.0 < out[held] < 1.0:
            held, mass = (j, sizes[j] * out[j]) if 0.0 < out[j] < 1.0 else (-1, 0.0)
    return np.array(out)


def _rounds(seed: int, level: int, last: bool):
    def f(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "key", "tie"], ascending=[False, True, True], ignore_index=True)
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(key[0]).encode()), int(key[1])])
        p = round_pairs(block["size"].to_numpy(), block["p"].to_numpy(), rng)
        if last:
            open_ = (p > 0) & (p < 1)
            p[open_] = rng.random(int(open_.sum())) < p[open_]
        return block.assign(p=p)

    return f


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Per source: ``source_size``, rows ``n``, and ``target`` words, of rows (source, size, m); m equal rows are one.

    Sources in code point order, null last, weigh ``weights``, repeating, and share the
    size of all. A target above ``max_repeats`` times its source's size is cut to that
    and the excess reshared by weight: the level words / weight of the sources that
    aren't cut is raised until no further source is. Each round is one aggregate, so the
    number of sources doesn't matter.
    """
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    ranked = numbered(stats, F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = written(ranked.withColumn("room", F.col("source_size") * float(max_repeats)), "mix-sources")
    level, cut = 0.0, -1
    while True:
        full = F.col("room") <= F.col("weight") * level if cut >= 0 else F.lit(False)
        now = ranked.agg(F.count_if(full).alias("cut"), F.sum(F.when(full, F.col("room"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.sum("source_size").alias("all")).first()
        if now["cut"] == cut or not now["weight"]:
            break
        cut, level = now["cut"], (float(now["all"]) - (now["taken"] or 0.0)) / now["weight"]
    target = F.least(F.col("room"), F.col("weight") * level) if now["weight"] else F.col("room")
    return ranked.select("source", "source_size", "n", target.alias("target"))


def plan_copies(sized: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """How often each row is taken.

    In: ``key`` (long, may repeat or be null), ``size`` (words), ``source``. Out: these,
    ``source_size``, ``target`` and ``copies`` (int). Equal rows are counted first and
    then numbered, so that each is rounded on its own in a block of its own draw and many
    of them spread like any others. Rows of size 0 carry no mass, and rows without a
    fraction need no rounding: neither goes through the blocks. Reruns over the same rows
    agree: draws depend on keys, sizes and numbers only.
    """
    equal = written(sized.groupBy("key", "size", "source").agg(F.count("*").alias("m")), "mix-sizes")
    targets = written(source_targets(equal, weights, max_repeats), "mix-targets")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    per = targets.select(F.col("source").alias("_source"), "source_size", "n", "target")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = equal.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("base", F.floor(expected)).withColumn("p", F.when(F.col("size") > 0, expected - F.col("base")).otherwise(F.lit(0.0)))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    # Numbers of many equal rows are made in parts that any task may take.
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PART_ROWS)))).repartition("key", "part")
    rows = rows.withColumn("tie", F.explode(F.sequence(F.col("part") * PART_ROWS + 1, F.least(F.col("m"), (F.col("part") + 1) * PART_ROWS))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key", "size", "tie"), blocks))
    rows = rows.select("key", "size", "source", "source_size", "target", "base", "p", "block", "tie")
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    done, level = [rows.where(~is_open)], 0
    rows = rows.where(is_open)
    most = targets.agg(F.max(F.ceil(F.col("n") / BLOCK_ROWS))).first()[0] or 1
    while True:
        last = most <= 1
        settled = written(rows.groupBy("source", "block").applyInPandas(_rounds(seed, level, last), rows.schema), f"mix-round{level}")
        if last:
            done.append(settled)
            break
        done.append(settled.where(~is_open))
        rows = settled.where(is_open).withColumn("block", F.floor(F.col("block") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("key", "size", "source", "source_size", "target", (F.col("base") + F.round("p")).cast("int").alias("copies"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, none if 0 times.

    The plan is made from (row hash, size, source) only; texts move once, in the join
    that brings the copies back. Rows that share id, text and source and are taken
    unequally often are told apart by the hash of the whole row; those that are equal
    in every column are counted, not listed. Null texts have size 0; a null source is a
    source of its own; a table without a ``source`` column is one source. Empty tables
    give no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source = column_or_null(docs, "source", "string")
    keyed = docs.select(row, F.xxhash64(column_or_null(docs, "doc_id", "string"), F.coalesce(column_or_null(docs, "text", "string"), F.lit("")), source).alias("key"), word_count(column_or_null(docs, "text", "string")).alias("size"), source.alias("source"))
    plan = plan_copies(keyed.select("key", "size", "source"), seed, weights, max_repeats)
    counts = plan.groupBy("key", "copies").agg(F.count("*").alias("n"))
    # Rows of a key share a source, so they are taken ``least`` or ``least + 1`` times.
    per = counts.groupBy("key").agg(F.min("copies").alias("least"), F.count("*").alias("kinds"), F.min_by("n", -F.col("copies")).alias("more"))
    per = written(per, "mix-plan")
    repeat = lambda df, n: df.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n))).select("row.*")
    slim = keyed.select("key", "row")
    out = repeat(slim.join(per.where("kinds = 1"), "key"), F.col("least"))
    mixed = per.where("kinds > 1")
    if mixed.isEmpty():
        return out
    equal = slim.join(mixed, "key").groupBy("key", "row", "least", "more").agg(F.count("*").alias("m"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("row"), F.to_json("row")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("m").over(order), F.lit(0))
    extra = F.least(F.col("m"), F.greatest(F.col("more") - before, F.lit(0)))
    return out.unionByName(repeat(equal.withColumn("times", F.col("least") * F.col("m") + extra), F.col("times")))
