"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Each part, an input split, permutes its rows by sorting them by a hash, without an
   exchange, and they are written once with their places, so that every later step, and
   every repeat of a lost task, sees the same rows in the same place.
2. A matrix is drawn that says how many rows of part i go to shard j: its row sums are
   the parts' sizes, its column sums the shards' exact sizes. The driver draws it for
   groups of parts, and a task for the parts of each group, so that any number of parts
   will do.
3. Rows go out by their places and their part's line of the matrix.
4. Each shard permutes what it got: a random block number, then a random order inside
   the block. Blocks bound what one task sorts, whatever the shard's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import written

#: Groups of parts that the driver draws for.
MAX_GROUPS = 4096
#: Lines of the matrix times shards up to which it is sent to every executor; beyond, it is joined.
SENT_CELLS = 1_000_000
#: Rows that one task sorts in the last step, on average.
BLOCK_ROWS = 65_536
_NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good.

    Beyond NumPy's limit of 1e9 by inversion: weights relative to the mode's follow from
    ratios of neighbours alone, so no large factorials lose digits; they are summed up to
    14 standard deviations on either side, beyond which less than 1e-40 is left.
    """
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return draws
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    total = float(good + bad)
    span = int(14 * (draws * (good / total) * (bad / total) * max(total - draws, 1.0) / total) ** 0.5) + 60
    up = mode + np.arange(min(span, high - mode), dtype=float)
    down = mode - np.arange(min(span, mode - low), dtype=float)
    above = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    ends = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))


def communication_matrix(parts: list[int], shards: list[int], seed) -> np.ndarray:
    """A random matrix with these row and column sums, as a uniform permutation makes it."""
    rng = np.random.default_rng(seed)
    left, out = list(shards), np.zeros((len(parts), len(shards)), dtype=np.int64)
    for i, rows in enumerate(parts):
        pool = sum(left)
        for j, room in enumerate(left):
            got = hypergeometric(rng, room, pool - room, rows)
            out[i, j], rows, pool = got, rows - got, pool - room
            left[j] -= got
    return out


def _lines(seed: int):
    """Of the parts of a group, which carries its own line ``dealt``: each part's line, summed up."""

    def f(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", ignore_index=True)
        matrix = communication_matrix(group["n"].tolist(), [int(x) for x in group["dealt"][0]], [seed, int(group["group"][0])])
        return pd.DataFrame({"part": group["part"], "dealt": list(np.cumsum(matrix, axis=1))})

    return f


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart that add up to ``rows``."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _free_name(name: str, taken) -> str:
    while name in taken:
        name = f"input_{name}"
    return name


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 20_240_229) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Every row, repeated rows and rows of nulls too, is dealt on its own; shard sizes
    differ by one at most; an empty table gives no rows. An input column named ``shard``
    or ``slot`` is kept under the name ``input_shard`` or ``input_slot``.
    """
    spark = df.sparkSession
    own = list(df.columns)
    for name in ("shard", "slot"):
        own = [_free_name(f"input_{c}", own) if c == name else c for c in own]
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, own, strict=True)]).alias("row")
    local = df.select(row, F.monotonically_increasing_id().alias("id")).sortWithinPartitions(F.xxhash64(F.lit(seed), "id"), "id")
    base = written(local.withColumn("place", F.monotonically_increasing_id()), "shard-rows")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = written(base.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("group", F.col("part") % MAX_GROUPS), "shard-sizes")
    groups = [(r["group"], r["n"]) for r in sizes.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect()]
    total = sum(n for _, n in groups)
    matrix = communication_matrix([n for _, n in groups], shard_sizes(total, shards), seed)
    # A row a group: a bound that doesn't grow with the data.
    top = spark.createDataFrame([(g, [int(x) for x in m]) for (g, _), m in zip(groups, matrix, strict=True)], "group long, dealt array<long>")
    lines = sizes.join(F.broadcast(top), "group").groupBy("group").applyInPandas(_lines(seed), "part long, dealt array<long>")
    lines = written(lines, "shard-lines")
    lines = F.broadcast(lines) if lines.count() * shards <= SENT_CELLS else lines
    dealt = base.select("row", "id", part.alias("part"), at.alias("_at")).join(lines, "part")
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    draw = F.xxhash64(F.lit(seed + 1), "id")
    placed = dealt.select(
        "row",
        "id",
        F.size(F.filter("dealt", lambda x: x <= F.col("_at"))).alias("shard"),
        draw.alias("_draw"),
    ).withColumn("_block", F.pmod(F.shiftright("_draw", 20), F.lit(blocks)).cast("int"))
    placed = written(placed, "shard-dealt") if blocks > 1 else placed
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_draw", "id")) - 1
    if blocks == 1:
        return placed.select("row.*", "shard", inside.cast("long").alias("slot"))
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_block", before.alias("_start"))
    return placed.withColumn("_in", inside).join(starts, ["shard", "_block"]).select("row.*", "shard", (F.col("_start") + F.col("_in")).cast("long").alias("slot"))
