import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexivane.llm import rules
from lexivane.llm.queries import tokenizer_path
from test_decontam import brute as brute_hits
from test_mixing import brute_targets
from test_rules import brute as brute_rules


@pytest.fixture(scope="module")
def folder(make, spark, edge, words, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    clean = lambda k, n=70: " ".join(f"the {words[(k * 7 + j) % 900]} of {words[(k * 13 + j * 3) % 900]}" for j in range(n))
    passage = " ".join(words[800:818])
    rows = [*edge, *((1000 + k, clean(k), "ab"[k % 2]) for k in range(60))]
    rows += [(2000, clean(5), "a"), (2001, clean(6) + " end", "b"), (2002, clean(100) .replace(" ", " | "), "a"), (2003, passage + " " + clean(101, 60), "a"), (2004, clean(102, 200) + " " + passage, "b")]
    make(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages_take_effect(spark, folder, tmp_path):
    d, rows = folder
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == names
    kept = [{r["doc_id"] for r in seen[n]} for n in seen]
    clean = set(range(1000, 1060))
    assert clean <= kept[0] and 2002 not in kept[0] and not kept[0] & {100, 101, 102, 105}
    assert clean <= kept[1] and 2000 not in kept[1] and {2003, 2004} <= kept[1]
    assert clean <= kept[2] and 2003 not in kept[2] and 2004 in kept[2]
    text = {r["doc_id"]: r["text"] for r in seen["decontaminate"]}
    assert text[2004] == dict((i, t) for i, t, _ in rows)[2004].rsplit(" ", 18)[0] + " "
    mixed = Counter(r["doc_id"] for r in seen["mix_sources"])
    assert set(mixed) <= set(text) and max(mixed.values()) <= 3
    model, start = Tokenizer.from_file(tokenizer_path()), 0
    got = sorted(seen["sstable_tokens"], key=lambda r: r["start"])
    assert Counter(r["doc_id"] for r in got) == mixed
    for r in got:
        ids = [*model.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0] if list(text).count(r["doc_id"]) == 1 and r["doc_id"] is not None else None
        assert r["start"] == start
        start += r["n_tokens"]
        if ids:
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    again = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_tables(spark, folder, tmp_path):
    d = folder[0]
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def rule_verdict(t):
    """The rule table in plain Python."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute_rules(t)
    t = t or ""
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    words_ = re.findall(r"[^\x20\x09-\x0D]+", t)
    stop, capitals = sum(w in rules.STOP_WORDS for w in words_), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÁÍÓÚ" for c in t)
    bullets, dots = sum(re.match(r"[\x20\x09]*[-*•]", x) is not None for x in lines), sum(x.endswith(("...", "…")) for x in lines)
    if n_words < 50 or 100 * n_repeat > 50 * n_words:
        return False
    fine = [2 * n_words <= word_chars <= 15 * n_words, 10 * n_symbols <= n_words, 2 * capitals <= word_chars, 50 * stop >= n_words]
    return all(fine) and 2 * n_dup <= len(lines) and 2 * n_repeat <= n_words and 10 * bullets <= 9 * len(lines) and 10 * dots <= 3 * len(lines)


def test_against_brute_force(spark, folder, tmp_path):
    """Rules, near copies and decontamination row by row; the mix by its targets; ids by the library."""
    d, rows = folder
    good = [r for r in rows if rule_verdict(r[1])]
    shingles = {}
    for n, (_, t, _) in enumerate(good):
        w = t.lower().split()
        shingles[n] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {n: n for n in shingles}
    find = lambda n: n if group[n] == n else find(group[n])
    for a in shingles:
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                group[find(a)] = find(b)
    first = {}
    for n, (i, _, _) in enumerate(good):
        at = find(n)
        if at not in first or (i is None, i or 0) < (good[first[at]][0] is None, good[first[at]][0] or 0):
            first[at] = n
    kept = [good[n] for n in first.values()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = Counter()
    for (i, t, s), (n, hit, _) in zip(kept, brute_hits([(i, t) for i, t, _ in kept], items), strict=True):
        if not (hit and 20 * hit >= n):
            clean[i, t if not hit else None, s] += 1
    docs, at = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        at[name] = docs.collect()
    triples = lambda name: Counter((r["doc_id"], r["text"], r["source"]) for r in at[name])
    assert triples("quality_rules") == Counter(good) and triples("simhash_dedup") == Counter(kept)
    left = triples("decontaminate")
    cut = {i for i, t, _ in clean if t is None}
    assert Counter({(i, None if i in cut else t, s): n for (i, t, s), n in left.items()}) == clean
    sizes, taken, most = Counter(), Counter(), Counter()
    for (_, t, s), n in left.items():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        sizes[s] += n * size
        most[s] = max(most[s], size)
    for (i, t, s), n in triples("mix_sources").items():
        assert n <= 3 * left[i, t, s]
        taken[s] += n * len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= most[s]
    model = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for (i, t, _), n in triples("mix_sources").items():
        ids = [*model.encode(t, add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in at["sstable_tokens"]) == want


def test_run_leaves_only_what_it_needs(spark, folder):
    from lexivane.llm import common

    before = len(common._made)
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0
    names = [p.rsplit("/", 1)[1] for p in common._made[before:]]
    assert sum(n.startswith("stage-") for n in names) == 1 and len(names) <= 4, names
