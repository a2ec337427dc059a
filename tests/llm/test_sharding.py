import zlib
from collections import Counter

import numpy as np
import pytest

from lexivane.llm import sharding


def test_matrix_margins():
    m = sharding.communication_matrix([5, 0, 17, 100], sharding.shard_sizes(122, 7), 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 100] and m.sum(axis=0).tolist() == sharding.shard_sizes(122, 7)


def test_matrix_follows_the_hypergeometric_law():
    rng = np.random.default_rng(1)
    cells = [sharding.communication_matrix([30, 70], [50, 50], int(rng.integers(1 << 60)))[0, 0] for _ in range(3000)]
    assert np.mean(cells) == pytest.approx(15, abs=0.2) and np.var(cells) == pytest.approx(30 * 0.25 * 70 / 99, rel=0.1)


def test_large_populations():
    rng = np.random.default_rng(2)
    draws = [sharding.hypergeometric(rng, 2_000_000_000, 6_000_000_000, 4_000_000) for _ in range(200)]
    assert np.mean(draws) == pytest.approx(1_000_000, rel=1e-3) and np.std(draws) == pytest.approx(866, rel=0.3)
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


@pytest.mark.parametrize("block", [65_536, 5])
def test_shards(make, edge, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    docs = make(edge).repartition(5, "lang", "doc_id")
    rows = sharding.shuffle_into_shards(docs, 4).collect()
    assert len(rows) == len(edge)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in edge)
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own))) and len(own) in (len(edge) // 4, -(-len(edge) // 4))
    assert {"size", "row", "key"} <= set(rows[0].asDict()) and rows[0]["row"] == "R"


def test_many_parts_share_groups_and_names_are_kept(spark, monkeypatch):
    """More parts than groups; columns named like the output; lines that are joined, not sent."""
    monkeypatch.setattr(sharding, "MAX_GROUPS", 3)
    monkeypatch.setattr(sharding, "SENT_CELLS", 0)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    df = spark.range(1_003).selectExpr("id as shard", "'x' as slot", "1 as input_slot").repartition(11)
    rows = sharding.shuffle_into_shards(df, 5).collect()
    assert sorted(r["input_shard"] for r in rows) == list(range(1_003)) and {r["input_input_slot"] for r in rows} == {"x"}
    for s in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own))) and len(own) in (200, 201)


def test_rows_of_a_part_go_everywhere(spark):
    """Each shard gets about its share of each tenth of the table, and not in the old order."""
    rows = sharding.shuffle_into_shards(spark.range(0, 20_000, 1, 4), 4, 5).collect()
    for s in range(4):
        own = [r["id"] for r in sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])]
        tenths = np.bincount(np.array(own) // 2_000, minlength=10)
        assert abs(tenths - 500).max() < 120
        assert abs(np.corrcoef(own, range(len(own)))[0, 1]) < 0.06


def test_few_rows_and_none(make):
    assert sharding.shuffle_into_shards(make([]), 16).count() == 0
    rows = sharding.shuffle_into_shards(make([(1, "a", "s"), (2, None, None)]), 16).collect()
    assert [r["slot"] for r in rows] == [0, 0] and rows[0]["shard"] != rows[1]["shard"]


def test_seeds_differ(make, edge):
    place = lambda seed: [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(make(edge), 4, seed).orderBy("doc_id", "shard", "slot").collect()]
    assert place(1) == place(1) != place(2)


def test_query_digests(spark, tmp_path, make, edge):
    from lexivane.llm.queries import QUERIES

    make(edge).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in QUERIES["op7_hypergeometric_shards"](spark, str(tmp_path)).collect())
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in edge)
