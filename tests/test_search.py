"""Search over the lazy and the stored index, against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexivane.functions.driver import ResultCache, lru_cache, timed
from lexivane.functions.text import tokenizer
from lexivane.operators import boolean, prefix, ranking, vectors
from lexivane.operators.index import build_index, open_index, store

PLAIN = tokenizer(())
#: Harbour log entries: (doc_id, title, body); one is empty, one in Arabic, ids sort as text.
LOG = [
    ("log-10", "Storm over the harbour", "boats stay boats wait"),
    ("log-2", "Calm sea", "boats leave at dawn"),
    ("log-3", "", "harbour lights and a calm night"),
    ("log-4", "", ""),
    ("log-5", "الْمِينَاء هادئ", "sea"),
    ("log-6", "storm storm storm", "lights out"),
]
WORDS = {"log-10": "storm over harbour boats stay boats wait", "log-2": "calm sea boats leave at dawn", "log-3": "harbour lights calm night", "log-4": "", "log-5": "الميناء هادئ sea", "log-6": "storm storm storm lights out"}
TERMS = {d: t.split() for d, t in WORDS.items()}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, title string, body string")


@pytest.fixture(scope="module", params=["lazy", "stored"])
def log(request, spark, tmp_path_factory):
    built = build_index(docs(spark, LOG))
    return built if request.param == "lazy" else store(built, str(tmp_path_factory.mktemp("index") / "log"))


def random_query(rng, depth):
    """A query text, and the ids that it should find."""
    if depth == 0 or rng.random() < 0.25:
        word = rng.choice(["storm", "boats", "SEA", "Calm", "lights", "harbour", "submarine", "الْمِينَاء", "هادئ"])
        term = {"الْمِينَاء": "الميناء"}.get(word, word.lower())
        return word, {d for d, t in TERMS.items() if term in t}
    kind = rng.choice(["AND", "or", "Or", "NOT", "and", "but"])
    left, a = random_query(rng, depth - 1)
    if kind == "NOT":
        return f"NOT ({left})", set(TERMS) - a
    right, b = random_query(rng, depth - 1)
    if kind == "but":  # AND may be left out before NOT
        return f"({left}) NOT ({right})", a - b
    return f"({left}) {kind} ({right})", a & b if kind.upper() == "AND" else a | b


def test_random_boolean_queries(log):
    rng = random.Random(21)
    for _ in range(14):
        text, want = random_query(rng, 3)
        assert boolean.search(log, text) == sorted(want), text


def test_precedence_without_parentheses(log):
    ids = lambda t: {d for d, x in TERMS.items() if t in x}
    assert boolean.search(log, "sea OR boats AND storm") == sorted(ids("sea") | ids("boats") & ids("storm"))
    assert boolean.search(log, "NOT storm AND calm") == sorted(ids("calm") - ids("storm"))
    t = lambda x: ("TERM", x)
    assert boolean.parse("p OR q AND NOT r OR s") == ("OR", ("OR", t("p"), ("AND", t("q"), ("NOT", t("r")))), t("s"))
    assert boolean.parse("p NOT q AND r") == ("AND", ("AND", t("p"), ("NOT", t("q"))), t("r"))


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("", "empty query"),
        ("and of the", "missing left operand for AND"),
        ("in", "empty query"),
        ("(storm", "unbalanced parentheses"),
        ("storm) sea", "unbalanced parentheses"),
        (")", "unbalanced parentheses"),
        ("(storm sea)", "unbalanced parentheses"),
        ("OR storm", "missing left operand for OR"),
        ("storm AND", "missing right operand for AND"),
        ("storm OR AND sea", "missing right operand for OR"),
        ("storm OR)", "missing right operand for OR"),
        ("NOT", "missing right operand for NOT"),
        ("sea NOT", "missing right operand for NOT"),
        ("()", "missing operand inside parentheses"),
        ("(an)", "missing operand inside parentheses"),
        ("(", "missing operand"),
        ("storm sea", "unexpected token 'sea'"),
        ("well-lit", "unexpected token 'lit'"),
        ("sea (storm)", r"unexpected token '\('"),
    ],
)
def test_boolean_errors(query, message):
    with pytest.raises(boolean.QueryParseError, match=f"^{message}$"):
        boolean.parse(query)


def test_id_set_operations(spark):
    ids = lambda s: spark.createDataFrame([(c,) for c in s], "doc_id string")
    got = lambda df: sorted(r[0] for r in df.collect())
    for a, b in itertools.product(["", "k", "kmx", "mxyz"], repeat=2):
        assert got(boolean.and_ids(ids(a), ids(b))) == sorted(set(a) & set(b))
        assert got(boolean.or_ids(ids(a), ids(b))) == sorted(set(a) | set(b))
        assert got(boolean.not_ids(ids(a), ids(b))) == sorted(set(b) - set(a))


def test_index_tables(log):
    counts = {d: Counter(t) for d, t in TERMS.items()}
    want = {(t, d, n, len(TERMS[d])) for d, c in counts.items() for t, n in c.items()}
    assert {tuple(r) for r in log.postings.collect()} == want
    assert {r["term"]: r["df"] for r in log.term_stats.collect()} == Counter(t for c in counts.values() for t in c)
    assert {tuple(r) for r in log.doc_stats.collect()} == {(d, len(t)) for d, t in TERMS.items()}
    stats = log.corpus_stats.first()
    assert stats["n_docs"] == 6 and stats["avg_len"] == pytest.approx(sum(map(len, TERMS.values())) / 6)
    assert [tuple(r) for r in log.term_postings("boats").collect()] == [("log-10", 2), ("log-2", 1)]
    assert [r[0] for r in log.document_ids().collect()] == sorted(TERMS)
    assert [r[0] for r in log.terms().collect()] == sorted({t for x in TERMS.values() for t in x})
    assert (log.num_docs(), log.doc_freq("storm"), log.doc_freq("whale"), log.doc_length("log-10"), log.doc_length("log-4")) == (6, 2, 0, 7, 0)
    with pytest.raises(KeyError):
        log.doc_length("log-99")


def test_snapshots(spark, log):
    with pytest.raises(ValueError, match="already exists"):
        log.add(docs(spark, [("log-2", "", "")]))
    gone = log.remove(spark.createDataFrame([("log-2",), ("log-77",)], "doc_id string"))
    assert (gone.version, gone.num_docs(), gone.doc_freq("boats"), log.doc_freq("boats")) == (2, 5, 1, 2)
    assert log.remove(spark.createDataFrame([("log-77",)], "doc_id string")) is log
    back = gone.add(docs(spark, [("log-2", "", "whale")]))
    assert (back.version, back.doc_freq("whale"), back.doc_freq("dawn")) == (3, 1, 0)
    with pytest.raises(ValueError, match="already exists"):
        build_index(docs(spark, [("p", "", ""), ("p", "x", "")]), check=True)


def test_stored_lookups_prune_by_term(spark, tmp_path):
    """Postings are in term order across and inside files, and the filter reaches the scan."""
    rows = [(f"d{k:04d}", "", " ".join(f"w{(k * 7 + j * 13) % 500:03d}" for j in range(20))) for k in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one file
    try:
        index = store(build_index(docs(spark, rows), PLAIN), str(tmp_path / "ix"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = index.postings.where("term = 'w123'")._jdf.queryExecution().toString()
    assert "EqualTo(term,w123)" in plan
    files = index.postings.selectExpr("input_file_name() as f", "term").groupBy("f").agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x["b"] <= y["a"] for x, y in itertools.pairwise(files))
    again = open_index(spark, str(tmp_path / "ix"), tokenizer=PLAIN)
    assert boolean.search(again, "w123 AND NOT w130") == sorted(d for d, _, t in rows if "w123" in t.split() and "w130" not in t.split())
    assert store(build_index(docs(spark, []), PLAIN), str(tmp_path / "none")).corpus_stats.first()["n_docs"] == 0


def test_prefix(spark):
    vocabulary = "pier pierce piers pine pilot tide ساحل سفينة سفن".split()
    table = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    for start, limit in itertools.product(["pi", "pier", "", "tides", "PI", "سف"], [10, 2, 0, -1]):
        want = sorted(w for w in vocabulary if w.startswith(start))[: max(limit, 0)]
        assert [r[0] for r in prefix.with_prefix(table, start, limit).collect()] == want
    assert prefix.contains(table, "pier") and not prefix.contains(table, "pi")
    assert prefix.common_prefix(table) == "pi"
    assert prefix.common_prefix(spark.createDataFrame([("xy",), ("k",)], "term string")) == "k"
    with pytest.raises(ValueError):
        prefix.common_prefix(spark.createDataFrame([], "term string"))


def tf_idf(words, query):
    df = Counter(t for w in words.values() for t in set(w))
    scores = {}
    for d, w in words.items():
        own = [t for t in query.lower().split() if t in w]
        if own:
            scores[d] = sum((1 + math.log(w.count(t))) * math.log(len(words) / df[t]) for t in own)
    return scores


def bm25(words, query, k1=1.5, b=0.75):
    df, mean = Counter(t for w in words.values() for t in set(w)), sum(map(len, words.values())) / len(words)
    scores = {}
    for d, w in words.items():
        own = [t for t in query.lower().split() if t in w]
        if own:
            idf = lambda t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5))
            scores[d] = sum(idf(t) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in own)
    return scores


@pytest.mark.parametrize("query", ["storm boats", "sea calm lights", "storm storm", "whale", "out"])
def test_rankers_against_formulas(log, query):
    for ranker, formula in ((ranking.TfIdf(log), tf_idf), (ranking.Bm25(log), bm25), (ranking.Bm25(log, 0.9, 0.4), lambda w, q: bm25(w, q, 0.9, 0.4))):
        want = formula(TERMS, query)
        got = ranker.rank_text(query)
        assert dict(got) == pytest.approx(want)
        assert [d for d, _ in got] == sorted(want, key=lambda d: (-round(want[d], 9), d))
        assert ranker.rank_text(query, 0) == []


def test_results_are_kept_by_version_text_and_k(log):
    ranker = ranking.TfIdf(log)
    for text, k in (("sea", 3), ("sea", 3), ("sea", 2), ("storm", 3)):
        ranker.rank_text(text, k)
    assert (ranker.cache.hits, ranker.cache.misses) == (1, 3)


def test_grid_is_every_setting_at_once(spark, log):
    queries = spark.createDataFrame([("a", "storm lights"), ("b", "boats sea")], "query_id string, text string")
    rows = ranking.bm25_grid(log, queries).collect()
    assert len({r["grid_pos"] for r in rows}) == 12
    for r in rows:
        assert r["score"] == pytest.approx(bm25(TERMS, {"a": "storm lights", "b": "boats sea"}[r["query_id"]], r["k1"], r["b"])[r["doc_id"]])
    for bad in ({"k1": 0}, {"b": -0.1}, {"b": 1.1}):
        with pytest.raises(ValueError):
            ranking.Bm25(log, **bad)


def test_mean_length_follows_snapshots(spark):
    first = build_index(docs(spark, [("s", "buoy", "")]), PLAIN)
    both = first.add(docs(spark, [("t", "buoy", "rope " * 6)]))
    assert [x.corpus_stats.first()["avg_len"] for x in (first, both)] == [1.0, 4.0]
    assert [d for d, _ in ranking.Bm25(both).rank_text("buoy")] == ["s", "t"]


def test_ranker_is_abstract(log):
    with pytest.raises(TypeError):
        ranking.Ranker(log)


def test_top_k_equals_sorting(spark):
    rng = random.Random(3)
    rows = [("q", f"n{i:03d}", float(rng.randint(-10, 10))) for i in range(100)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, score double")
    full = [d for _, d, s in sorted(rows, key=lambda r: (-r[2], r[1]))]
    for k in (1, 7, 50, 110):
        assert [r["doc_id"] for r in ranking.top_k(df, k).orderBy("rank").collect()] == full[:k]
    assert ranking.top_k(df, 0).count() == 0


def unit_vectors(words):
    df, out = Counter(t for w in words.values() for t in set(w)), {}
    for d, w in words.items():
        raw = {t: (1 + math.log(n)) * math.log(len(words) / df[t]) for t, n in Counter(w).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[d] = {t: x / norm for t, x in raw.items() if x}
    return out


def test_vectors_and_neighbours(log):
    want = unit_vectors(TERMS)
    got = {(r["doc_id"], r["term"]): r["w"] for r in vectors.document_vectors(log).collect()}
    assert got == pytest.approx({(d, t): x for d, v in want.items() for t, x in v.items()})
    for one in ("log-10", "log-4"):
        cosine = {d: sum(x * want[one].get(t, 0.0) for t, x in v.items()) for d, v in want.items() if d != one}
        near = vectors.more_like_this(log, one)
        assert [d for d, _ in near] == sorted(cosine, key=lambda d: (-round(cosine[d], 9), d))
        assert dict(near) == pytest.approx(cosine)
    assert vectors.more_like_this(log, "log-2", 0) == []
    with pytest.raises(KeyError, match="Unknown document ID: log-99"):
        vectors.more_like_this(log, "log-99", 0)


def test_result_cache():
    calls = []
    f = lru_cache(2)(lambda x: calls.append(x) or x * 2)
    assert [f(1), f(2), f(1), f(3), f(2)] == [2, 4, 2, 6, 4]
    assert calls == [1, 2, 3, 2] and (f.cache.hits, f.cache.misses) == (1, 4)
    f.cache_clear()
    assert f.cache.misses == 0
    with pytest.raises(ValueError):
        ResultCache(0)
    c = ResultCache()
    with pytest.raises(ZeroDivisionError):
        c.get("k", lambda: 1 / 0)
    assert c.misses == 1 and c.get("k", lambda: 5) == 5


def test_timed():
    f = timed(lambda: 1)
    assert f.last_duration is None and f() == 1 and f.last_duration >= 0
