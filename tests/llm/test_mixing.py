import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.llm import mixing
from lexivane.llm.common import word_count


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 100, None: 7}, {"x": 5}, {"a": 0, "b": 0}, {"b": 3, "a": 3, "Z": 3, "é": 3, None: 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, m) for s, k in sizes.items() for n, m in (((1, k),) if k else ((0, 1),))], "source string, size long, m long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_pairs_keep_mass_and_expectation():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 500, 200))[::-1]
    p = rng.random(200)
    total = np.zeros(200)
    for seed in range(400):
        out = mixing.round_pairs(size, p, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 1 and out.min() >= 0 and out.max() <= 1
        assert out @ size == pytest.approx(p @ size)
        total += out
    assert np.abs(total / 400 - p).max() < 0.15


def sized(docs):
    return docs.select(F.col("doc_id").alias("key"), word_count(F.col("text")).alias("size"), "source")


def test_plan(make, edge, words, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    rows = [*edge, *((1000 + i, " ".join(words[: int(rng.integers(1, 60))]), ["hot", "hot", "y", "z"][i % 4]) for i in range(1200))]
    plan = [r.asDict() for r in mixing.plan_copies(sized(make(rows))).collect()]
    again = [r.asDict() for r in mixing.plan_copies(sized(make(rows[::-1])).repartition(7)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(plan, key=key) == sorted(again, key=key)
    assert Counter((r["key"], r["size"]) for r in plan) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in plan:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for s, t in target.items():
        assert t == pytest.approx(want[s])
        assert abs(taken[s] - t) <= largest[s]
    assert abs(taken["hot"] - target["hot"]) < 30


def test_mix_repeats_rows(make, edge):
    docs = make(edge)
    plan = Counter()
    for r in mixing.plan_copies(sized(docs)).collect():
        plan[r["key"]] += r["copies"]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    originals = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in rows} <= originals
    totals = defaultdict(int)
    for r in rows:
        totals[r["source"]] += len((r["text"] or "").split())
    want = brute_targets({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in edge if x == s) for s in {x for *_, x in edge}})
    assert totals["c"] == 0 and abs(totals["b"] - want["b"]) < 150
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))


def test_many_equal_rows_spread_over_blocks(spark, monkeypatch):
    """50,000 rows without an id and of one size: no block holds more than its share."""
    monkeypatch.setattr(mixing, "PART_ROWS", 1_000)
    rows = spark.range(50_000).selectExpr("cast(null as long) as key", "10L as size", "'a' as source")
    rows = rows.unionByName(spark.range(1_000).selectExpr("id as key", "id % 7 as size", "'b' as source"))
    real = mixing.round_pairs
    monkeypatch.setattr(mixing, "_rounds", lambda seed, level, last: _counted(seed, level, last, real))
    plan = mixing.plan_copies(rows)
    by = plan.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert {r["source"]: r["n"] for r in by} == {"a": 50_000, "b": 1_000}
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in by)


def _counted(seed, level, last, real):
    import zlib

    def f(key, block):
        assert len(block) < 3 * 2_000, len(block)
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(key[0]).encode()), int(key[1])])
        p = real(block["size"].to_numpy(), block["p"].to_numpy(), rng)
        if last:
            open_ = (p > 0) & (p < 1)
            p[open_] = rng.random(int(open_.sum())) < p[open_]
        return block.assign(p=p)

    return f


def test_rows_that_differ_elsewhere_keep_their_copies(spark):
    """Of rows with one id, text and source the same ones are taken again after any reordering."""
    rows = [(1, "one two three four five", "s", n) for n in range(40) for _ in range(3)] + [(2, "a b", "t", 0)] * 30 + [(k, "c " * (k % 5 + 1), "t", 0) for k in range(3, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    assert sorted(map(tuple, mixing.mix(docs.repartition(9)).collect())) == first
    plan = mixing.plan_copies(docs.select(F.xxhash64(F.col("doc_id").cast("string"), "text", "source").alias("key"), word_count(F.col("text")).alias("size"), "source"))
    assert plan.agg(F.sum("copies")).first()[0] == len(first)


def test_empty_and_missing_columns(spark, make):
    assert mixing.mix(make([])).count() == mixing.plan_copies(sized(make([]))).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
