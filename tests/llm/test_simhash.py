import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexivane.llm import simhash


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ps = list(parent)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_documents_against_brute_force(make, edge, words):
    base = " ".join(words[:400])
    near = [(300 + i, base + f" {words[500 + i]}", "a") for i in range(8)]
    rows = [*edge, *near, (310, base.upper(), "a"), (311, base, "a")]
    got = simhash.near_duplicates(make(rows).select(F.col("doc_id").alias("id"), "text")).collect()
    assert len(got) == len(rows)
    prints = {i: brute_print(t) for i, t, _ in rows if i is not None}
    roots = brute_components({brute_print(t) for _, t, _ in rows})
    least = defaultdict(lambda: 1 << 60)
    for i, t, _ in rows:
        if i is not None:
            least[roots[brute_print(t)]] = min(least[roots[brute_print(t)]], i)
    for r in got:
        if r["id"] is not None:
            assert r["fp"] % (1 << 64) == prints[r["id"]]
        assert r["component_id"] == least[roots[r["fp"] % (1 << 64)]] or least[roots[r["fp"] % (1 << 64)]] == 1 << 60


def ball(rng, centre, n, most):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("large", [20_000, 30])
def test_links_connect_what_brute_force_connects(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_RUN", 8)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for n, most in ((120, 3), (60, 6), (80, 9)):
        prints |= ball(rng, rng.getrandbits(64), n, most)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 4):
        prints.add(chain := chain ^ (15 << b))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash.links(df, large)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4 for r in links.collect())
    found = {r["node"] % (1 << 64): r["root"] for r in simhash.components(links).collect()}
    want = brute_components(prints)
    groups = defaultdict(set)
    for p, r in want.items():
        groups[r].add(p)
    for members in groups.values():
        if len(members) == 1:
            assert not members & set(found)
        else:
            assert len({found[m] for m in members}) == 1
    assert len({found[m] for m in found}) == sum(len(m) > 1 for m in groups.values())


def test_large_buckets_are_cut_until_they_are_small(spark):
    """Fingerprints that agree in all but 22 bits, far more of them than a bucket may hold."""
    rng = random.Random(3)
    high = rng.getrandbits(42) << 22
    prints = {high | rng.getrandbits(22) for _ in range(700)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    found = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df, 40)).collect()}
    groups = defaultdict(set)
    for p, r in brute_components(prints).items():
        groups[r].add(p)
    for members in groups.values():
        assert len({found[m] for m in members}) == 1 if len(members) > 1 else not members & set(found)


def test_many_copies_without_an_id(spark):
    rows = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'the very same text of some words here' as text", "id as extra")
    rows = rows.unionByName(spark.createDataFrame([(7, "another text altogether, of other words", 1), (8, None, 2)], "doc_id long, text string, extra long"))
    for width, similarity in ((4, None), (5, 0.8)):
        kept = simhash.keep_one(rows, width, similarity).collect()
        assert sorted((r["doc_id"] or 0 for r in kept)) == [0, 7, 8] and len(kept) == 3


def test_one_segment_differs_by_a_bit_at_most():
    rng = random.Random(1)
    for _ in range(500):
        x = 0
        for b in rng.sample(range(64), 4):
            x |= 1 << b
        assert min((x >> a & ((1 << w) - 1)).bit_count() for a, w in simhash.segments()) <= 1


def test_forest_spans():
    f = np.array([0, 1, 3, 7, 15, 31, 0x3F << 40], dtype=np.uint64)
    a, b = simhash._forest(f)
    assert len(a) == 5 and all(np.bitwise_count(a ^ b) <= 4)


def test_keep_one(make, edge, words):
    base = " ".join(words[:300])
    rows = [*edge, (400, base, "a"), (399, base + " " + words[700], "b"), (398, base, None)]
    docs = make(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    comps = simhash.near_duplicates(docs.select(F.col("doc_id").alias("id"), "text")).select("root").distinct().count()
    assert len(got) == comps and [g for g in got if g[1] in (398, 399, 400)] == [(False, 398)]
    assert sum(g[1] in (110, 111) for g in got) == 1
    assert simhash.keep_one(make([])).count() == 0


def brute_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_stage_drops_near_copies_of_similarity_080(make, edge):
    rng = random.Random(4)
    rows = [r for r in edge if r[0] is not None and r[0] < 60]
    for k in range(40):
        words = ["w%05d" % rng.randrange(99_999) for _ in range(200)]
        for i, changes in enumerate((0, 2, 3, 4, 9)):
            copy = list(words)
            for at in range(changes):
                copy[10 + at * 20] = f"changed{i}x{at}"
            rows.append((1000 + 10 * k + i, " ".join(copy), "a"))
    texts = {i: t for i, t, _ in rows}
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(None, make(rows), None).collect()}
    for k in range(40):
        ids = [1000 + 10 * k + i for i in range(5)]
        similar = [brute_jaccard(texts[ids[0]], texts[i]) >= 0.8 for i in ids]
        assert similar == [True, True, True, True, False]
        assert kept & set(ids) == {ids[0], ids[4]}
    assert {i for i, _, _ in rows if i < 60} <= kept


def test_candidates_in_blocks_lose_no_link(spark, monkeypatch):
    """A chain of near copies, each like its neighbours only, over many small blocks."""
    rng = random.Random(6)
    words = ["c%05d" % rng.randrange(99_999) for _ in range(120)]
    rows = []
    for k in range(60):
        words = list(words)
        words[(2 * k) % 120] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join("d%05d" % rng.randrange(99_999) for _ in range(40))) for k in range(30)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    run = lambda: {r["id"]: r["root"] for r in simhash.near_copies(docs, 5, 0.8).collect()}
    whole = run()
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 900)
    blocks = run()
    classes = lambda found: {frozenset(i for i in found if found[i] == r) for r in found.values()}
    assert classes(blocks) == classes(whole)
    assert frozenset(range(60)) in classes(whole) and frozenset({2000, 2001}) in classes(whole) and len(classes(whole)) == 32


def wide_print(text):
    """The stage's fingerprint of one text, bit by bit in plain Python."""
    hashes = {xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in five_word_shingles(text)}
    out = []
    for factor, term in zip(map(int, simhash._FACTORS), map(int, simhash._TERMS), strict=True):
        counts = [0] * 64
        for h in hashes:
            x = (h * factor + term) % (1 << 64)
            x ^= x >> 32
            x = x * 0xBF58476D1CE4E5B9 % (1 << 64)
            x ^= x >> 29
            for b in range(64):
                counts[b] += x >> b & 1
        out.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(hashes)))
    return out


def five_word_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_wide_fingerprint_against_plain_python():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 6, 70, 700):
        text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
        got = simhash.wide_fingerprint(simhash.shingle_set(text.encode(), 5))
        assert got.tolist() == wide_print(text)


def meets(a, b):
    """Of two fingerprints: some word has a piece in common, one a bit apart at most, and the words to check are close."""
    for w in range(simhash.WORDS):
        x = a[w] ^ b[w]
        apart = [(x >> first & ((1 << width) - 1)).bit_count() for first, width in simhash.pieces()]
        close = sum((a[(w + k) % simhash.WORDS] ^ b[(w + k) % simhash.WORDS]).bit_count() for k in range(simhash.CHECKED))
        if 0 in apart and sum(d <= 1 for d in apart) > 1 and close <= simhash.RADIUS:
            return True
    return False


@pytest.mark.parametrize("routed", [50_000, 3])
def test_candidates_are_those_of_simhash_variants(spark, monkeypatch, routed):
    """Near copies meet by their fingerprints' pieces and variants, unrelated texts don't; blocks change nothing."""
    monkeypatch.setattr(simhash, "SMALL_RUN", 4)
    rng = random.Random(10)
    prints = []
    for _ in range(25):
        words = ["s%05d" % rng.randrange(99_999) for _ in range(100)]
        for changes in (0, 1, 2, 5, 9):
            copy = list(words)
            for at in rng.sample(range(100), changes):
                copy[at] = "t%05d" % rng.randrange(99_999)
            prints.append(simhash.wide_fingerprint(simhash.shingle_set(" ".join(copy).encode(), 5)).tolist())
    signed = [(k, [simhash._signed(x) for x in p]) for k, p in enumerate(prints)]
    links = simhash.similar_links(spark.createDataFrame(signed, "fp long, words array<long>"), routed)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    group = list(range(len(prints)))
    for _ in prints:
        before = list(group)
        for a in range(len(prints)):
            for b in range(a):
                if group[a] != group[b] and meets(prints[a], prints[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    assert [found.get(k, k) for k in range(len(prints))] == group
    assert all(group[k] // 5 == k // 5 for k in range(len(prints))) and 25 <= len(set(group)) < 75


def test_stage_links_by_simhash(make, monkeypatch):
    """Without a bit of tolerance only equal fingerprints would meet: the stage has no other way to near copies."""
    rng = random.Random(12)
    words = ["v%05d" % rng.randrange(99_999) for _ in range(150)]
    docs = make([(1, " ".join(words), "a"), (2, " ".join([*words, "end"]), "a"), (3, " ".join(words), "b")])
    ids = lambda: sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(None, docs, None).collect())
    assert ids() == [1]
    monkeypatch.setattr(simhash, "similar_links", lambda distinct: distinct.selectExpr("fp as a", "fp as b"))
    assert ids() == [1, 2]


def test_recall_of_pairs_at_similarity_080():
    """Pairs of just 0.8, the hardest: sets of 400 with 50 of each one's own shingles, and parts of others."""
    rng = np.random.default_rng(7)
    missed = 0
    for common, left, right in [(400, 50, 50), (400, 100, 0)] * 1000:
        x = rng.integers(0, 1 << 64, common + left + right, dtype=np.uint64)
        a, b = (simhash.wide_fingerprint(np.concatenate([x[:common], y])).tolist() for y in (x[common : common + left], x[common + left :]))
        missed += not meets(a, b)
    assert missed <= 4


def test_similar_groups_against_brute_force():
    rng = random.Random(8)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randint(1, 60))], dtype=np.uint64)) for _ in range(120)]
    group = simhash.similar_groups(sets, 0.8)
    near = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    want = list(range(len(sets)))
    links = [[j for j in range(len(sets)) if near(sets[i], sets[j])] for i in range(len(sets))]
    for _ in sets:
        want = [min(want[j] for j in of) for of in links]
    assert len(set(want)) < len(sets) and group.tolist() == want


def test_empty(make):
    assert simhash.near_duplicates(make([]).select(F.col("doc_id").alias("id"), "text")).count() == 0
