"""Registered queries over the driver's tables and their DuckDB counterparts.

documents is the corpus (ids as strings), benchmark the queries; a document is relevant
to an item if it holds the item's first eight terms in a row. orders and lineitem give
interactions: customer, part, and a rating of 1 to 5 from the quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivane.functions.tables import cut, dealt, new_folder, small, spread
from lexivane.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS, tokenize
from lexivane.operators import boolean, classify, cluster, evaluation, factorization, index, prefix, ranking, recommend, significance, synthetic, vectors
from lexivane.sources.readers import from_tables, merge_qrels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _built(spark, d) -> index.Index:
    return index.build_index(from_tables(spread(_table(spark, d, "documents"))))


_folders: dict[tuple[str, str], str] = {}


def _index(spark, d) -> index.StoredIndex:
    """The written index of ``d``: built by the first query of a session that asks for it, read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _folders:
        folder = new_folder(spark, "index")
        index.store(_built(spark, d), folder)
        _folders[key] = folder
    return index.open_index(spark, _folders[key])


def _queries(spark, d) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


PASSAGE = 8


def _qrels(spark, d, last: bool = False) -> DataFrame:
    """(query_id, doc_id) of documents that hold an item's first, or last, terms in a row.

    Only documents with the rarest of these terms, which postings tell, are read.
    """
    ix = _index(spark, d)
    heads = _queries(spark, d).select("query_id", tokenize(F.col("text")).alias("t")).where(F.size("t") >= PASSAGE)
    heads = cut(heads.select("query_id", F.slice("t", -PASSAGE if last else 1, PASSAGE).alias("run")))
    each = heads.select("query_id", F.explode(F.array_distinct("run")).alias("term"))
    rare = each.join(ix.frequencies(each.select("term").distinct()), "term").groupBy("query_id").agg(F.min(F.struct("df", "term"))["term"].alias("term"))
    maybe = cut(ix.postings.select("term", "doc_id").join(small(cut(rare)), "term").join(small(heads), "query_id").select("doc_id", "query_id", "run"))
    docs = ix.docs.where(F.size("terms") >= PASSAGE).join(small(maybe, 20_000), "doc_id")
    # Runs begin where the first term stands.
    starts = F.filter(F.sequence(F.lit(1), F.size("terms") - PASSAGE + 1), lambda i: F.get("terms", i - 1) == F.col("run")[0])
    return docs.where(F.exists(starts, lambda i: F.slice("terms", i, PASSAGE) == F.col("run"))).select("query_id", "doc_id").distinct()


def _interactions(spark, d, which: str = "true") -> DataFrame:
    """(user_id, doc_id, rating), the largest of each pair; keys move as numbers, not as texts."""
    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    n = li.count()
    rows = dealt(o, n, "o_orderkey").join(dealt(li, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).where(which)
    rating = F.ceil(F.col("l_quantity") / 10).cast("int")
    best = dealt(rows.select("o_custkey", "l_partkey", rating.alias("rating")), n, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.max("rating").alias("rating"))
    return best.select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("doc_id"), "rating")


def _labelled(spark, d) -> DataFrame:
    docs, labels = spread(_table(spark, d, "documents")), _table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("quality").alias("label"))


def _r6(c):
    return F.round(c, 6)


_drop = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tok(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(translate(regexp_replace({c}, '[\x{{064B}}-\x{{0652}}\x{{0670}}]', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}')), '[\p{{L}}\p{{N}}]+'), lambda t: t NOT IN ({_drop}))"


_BASE = f"""WITH d AS (SELECT doc_id::VARCHAR AS doc_id, {_tok("coalesce(text, '')")} AS terms FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM d)"""
_ASK = f"""{_BASE},
q AS (SELECT item_id::VARCHAR AS query_id, {_tok('text')} AS terms FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY ALL),
h AS (SELECT query_id, qtf, p.doc_id, tf, df, len(d.terms) AS doc_len, n_docs, avg_len
  FROM qt JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id), s)"""
_TFIDF = "(1 + ln(tf)) * ln(n_docs::DOUBLE / df)"


def _bm25(k1, b) -> str:
    return f"ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * doc_len / avg_len))"


def _ranked(part: str, name: str = "r") -> str:
    return f"""{name}s AS (SELECT query_id, doc_id, sum(qtf * {part}) AS score FROM h GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}s) WHERE rank <= {K})"""


def _passages(name: str, part: str) -> str:
    return f"""{name} AS (SELECT DISTINCT query_id, doc_id FROM (SELECT doc_id, unnest(list_transform(range(1, len(terms) - {PASSAGE - 2}), lambda i: terms[i:i + {PASSAGE - 1}])) AS run FROM d)
  JOIN (SELECT query_id, {part} AS run FROM q WHERE len(terms) >= {PASSAGE}) USING (run))"""


_QRELS = _passages("rel", f"terms[1:{PASSAGE}]")


def _metrics(ranked: str, name: str = "m", by: str = "") -> str:
    """Per labelled query: precision, recall, rr, ndcg."""
    cells = f"(SELECT query_id, n_rel{by} FROM n, (SELECT DISTINCT {by.lstrip(', ')} FROM {ranked}))" if by else "n"
    return f"""n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
{name} AS (SELECT c.query_id{by}, coalesce(hits, 0) / {K}::DOUBLE AS precision, coalesce(hits, 0) / n_rel::DOUBLE AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr,
  coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, {K}) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS ndcg
  FROM {cells} c LEFT JOIN (SELECT query_id{by}, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg
    FROM {ranked} JOIN rel USING (query_id, doc_id) GROUP BY ALL) x USING (query_id{by}))"""


# --- index ---


@query(f"SELECT doc_id::VARCHAR AS doc_id, array_to_string({_tok('text')}, ' ') AS terms FROM documents")
def tokenize_documents(spark, d):
    return _built(spark, d).docs.select("doc_id", F.array_join("terms", " ").alias("terms"))


@query(f"{_BASE} SELECT doc_id, term, tf FROM p")
def term_freq(spark, d):
    """The whole build of postings, from the texts."""
    return index.build_index(from_tables(_table(spark, d, "documents")), cluster=True).postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query(f"{_BASE} SELECT term, df FROM f")
def doc_freq(spark, d):
    return _index(spark, d).term_stats


@query(f"{_BASE} SELECT doc_id, len(terms)::BIGINT AS doc_len FROM d")
def doc_stats(spark, d):
    return _index(spark, d).doc_stats.select("doc_id", F.col("doc_len").cast("long").alias("doc_len"))


@query(f"{_BASE} SELECT n_docs, round(avg_len, 6) AS avg_len FROM s")
def corpus_stats(spark, d):
    return _index(spark, d).corpus_stats.select("n_docs", _r6("avg_len").alias("avg_len"))


@query(f"{_BASE} SELECT term FROM f")
def vocabulary(spark, d):
    return _index(spark, d).terms()


@query(f"{_BASE} SELECT doc_id, tf FROM p WHERE term = 'that'")
def postings_lookup(spark, d):
    return _index(spark, d).term_postings("that").select("doc_id", F.col("tf").cast("long").alias("tf"))


_german = "SELECT doc_id::VARCHAR FROM documents WHERE lang = 'de'"


@query(f"{_BASE} SELECT term, count(*) AS df FROM p WHERE doc_id NOT IN ({_german}) GROUP BY term")
def index_remove(spark, d):
    docs = _table(spark, d, "documents")
    return _built(spark, d).remove(docs.where("lang = 'de'").select(F.col("doc_id").cast("string").alias("doc_id"))).term_stats


@query(f"{_BASE} SELECT term, count(*) AS df FROM p GROUP BY term")
def index_add(spark, d):
    docs = _table(spark, d, "documents")
    first = index.build_index(from_tables(docs.where("lang <> 'de'")))
    return first.add(from_tables(docs.where("lang = 'de'"))).term_stats


# --- Boolean and prefix queries ---

_BOOLEAN = {
    "bool_term": ("that", "list_contains(terms, 'that')"),
    "bool_and": ("that AND with", "list_contains(terms, 'that') AND list_contains(terms, 'with')"),
    "bool_or": ("die OR que", "list_contains(terms, 'die') OR list_contains(terms, 'que')"),
    "bool_not": ("NOT that", "NOT list_contains(terms, 'that')"),
    "bool_nested": ("((that AND with) OR (die AND NOT nicht))", "(list_contains(terms, 'that') AND list_contains(terms, 'with')) OR (list_contains(terms, 'die') AND NOT list_contains(terms, 'nicht'))"),
    "bool_implicit_and_not": ("que OR that NOT with", "list_contains(terms, 'que') OR (list_contains(terms, 'that') AND NOT list_contains(terms, 'with'))"),
}


def _boolean(text):
    return lambda spark, d: boolean.matching(_index(spark, d), text)


for _name, (_text, _sql) in _BOOLEAN.items():
    QUERIES[_name] = _boolean(_text)
    ORACLE_SQL[_name] = f"{_BASE} SELECT doc_id FROM d WHERE {_sql}"


@query(f"{_BASE} SELECT doc_id FROM (SELECT doc_id FROM d WHERE list_contains(terms, 'that') INTERSECT SELECT doc_id FROM d WHERE list_contains(terms, 'with')) UNION SELECT doc_id FROM d WHERE NOT list_contains(terms, 'was')")
def set_operations(spark, d):
    ix = _index(spark, d)
    ids = {w: boolean.matching(ix, w) for w in ("that", "with", "was")}
    return boolean.or_ids(boolean.and_ids(ids["that"], ids["with"]), boolean.not_ids(ids["was"], ix.docs.select("doc_id")))


@query(f"{_BASE} SELECT term FROM f WHERE term LIKE 'th%' ORDER BY term LIMIT {K}")
def prefix_search(spark, d):
    return prefix.with_prefix(_index(spark, d).term_stats, "th", K)


@query(f"{_BASE} SELECT w AS word, w IN (SELECT term FROM f) AS found FROM (VALUES ('that'), ('tha'), ('nicht'), ('')) v(w)")
def prefix_contains(spark, d):
    asked = spark.createDataFrame([("that",), ("tha",), ("nicht",), ("",)], "word string")
    known = _index(spark, d).term_stats.select(F.col("term").alias("word"), F.lit(True).alias("found"))
    return asked.join(known, "word", "left").select("word", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"{_BASE} SELECT substr(term, 1, 2) AS prefix FROM f WHERE length(term) > 2 GROUP BY ALL ORDER BY count(*) DESC, prefix LIMIT 1")
def top_prefix(spark, d):
    return spark.createDataFrame([(prefix.common_prefix(_index(spark, d).term_stats),)], "prefix string")


# --- ranking and evaluation ---

_shown = "query_id, doc_id, rank::INT AS rank, round(score, 6) AS score"


def _show(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), _r6("score").alias("score"))


@query(f"{_ASK}, {_ranked(_TFIDF)} SELECT {_shown} FROM r")
def tfidf_rank(spark, d):
    return _show(ranking.TfIdf(_index(spark, d)).rank(_queries(spark, d), K))


@query(f"{_ASK}, {_ranked(_bm25(1.5, 0.75))} SELECT {_shown} FROM r")
def bm25_rank(spark, d):
    return _show(ranking.Bm25(_index(spark, d)).rank(_queries(spark, d), K))


_twice = _ASK.replace(f"{_tok('text')} AS terms FROM benchmark", f"{_tok('text || chr(32) || text')} AS terms FROM benchmark")


@query(f"{_twice}, {_ranked(_bm25(1.5, 0.75))} SELECT {_shown} FROM r")
def bm25_repeated_terms(spark, d):
    doubled = _queries(spark, d).select("query_id", F.concat_ws(" ", "text", "text").alias("text"))
    return _show(ranking.Bm25(_index(spark, d)).rank(doubled, K))


_GRID = [(i, k1, b) for i, (k1, b) in enumerate((k1, b) for k1 in ranking.K1_GRID for b in ranking.B_GRID)]
_grid_sums = " UNION ALL ".join(f"SELECT {i} AS grid_pos, {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, query_id, doc_id, sum(qtf * {_bm25(k1, b)}) AS score FROM h GROUP BY ALL" for i, k1, b in _GRID)
_grid = f"""{_ASK}, gs AS ({_grid_sums}),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_pos, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM gs) WHERE rank <= {K}),
{_QRELS}, {_metrics('g', 'm', ', grid_pos, k1, b')},
gm AS (SELECT grid_pos, k1, b, avg(precision) AS precision, avg(recall) AS recall, avg(rr) AS mrr, avg(ndcg) AS ndcg FROM m GROUP BY ALL)"""


def _grid_metrics(spark, d) -> DataFrame:
    rel = cut(_qrels(spark, d))
    asked = cut(_queries(spark, d).join(rel.select("query_id").distinct(), "query_id", "left_semi"))
    return evaluation.mean_metrics(ranking.bm25_grid(_index(spark, d), asked, K), asked, rel, K, by=("grid_pos", "k1", "b"))


_means = ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "mrr", "ndcg"))


@query(f"{_grid} SELECT grid_pos, k1, b, {_means} FROM gm")
def bm25_grid(spark, d):
    return _grid_metrics(spark, d).select("grid_pos", "k1", "b", *[_r6(c).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(f"{_grid} SELECT k1, b, round(ndcg, 6) AS ndcg FROM gm ORDER BY round(ndcg, 12) DESC, grid_pos LIMIT 1")
def best_bm25(spark, d):
    return evaluation.best_setting(_grid_metrics(spark, d)).select("k1", "b", _r6("ndcg").alias("ndcg"))


_pivot = ", ".join(f"round(max(CASE WHEN k1 = {k1} THEN ndcg END), 6) AS k1_{str(k1).replace('.', '_')}" for k1 in ranking.K1_GRID)


@query(f"{_grid} SELECT b, {_pivot} FROM gm GROUP BY b")
def grid_pivot(spark, d):
    wide = evaluation.grid_table(_grid_metrics(spark, d), ranking.K1_GRID)
    return wide.select("b", *[_r6(F.col(f"`{k1}`")).alias(f"k1_{str(k1).replace('.', '_')}") for k1 in ranking.K1_GRID])


@query(f"{_ASK}, {_QRELS} SELECT query_id, doc_id FROM rel")
def qrels_filter(spark, d):
    return _qrels(spark, d)


@query(f"{_ASK}, {_QRELS}, {_passages('rel2', f'terms[len(terms) - {PASSAGE - 1}:len(terms)]')} SELECT query_id, doc_id FROM rel UNION SELECT query_id, doc_id FROM rel2")
def qrels_merge(spark, d):
    return merge_qrels(_qrels(spark, d), _qrels(spark, d, last=True))


_eval = f"{_ASK}, {_ranked(_bm25(1.2, 0.75))}, {_QRELS}, {_metrics('r')}"


@query(f"{_eval} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m")
def eval_metrics(spark, d):
    asked = _queries(spark, d)
    found = evaluation.mean_metrics(ranking.Bm25(_index(spark, d), 1.2, 0.75).rank(asked, K), asked, cut(_qrels(spark, d)), K)
    return found.select(*[_r6(c).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(f"{_eval} SELECT query_id, round(ndcg, 6) AS ndcg FROM m")
def per_query_ndcg(spark, d):
    asked = _queries(spark, d)
    rows = evaluation.per_query_ndcg(ranking.Bm25(_index(spark, d), 1.2, 0.75).rank(asked, K), asked, cut(_qrels(spark, d)), K)
    return rows.select("query_id", _r6("ndcg").alias("ndcg"))


# --- vectors ---

_VECTORS = f"""{_BASE}, raw AS (SELECT doc_id, term, {_TFIDF} AS x FROM p JOIN f USING (term), s),
v AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM raw WHERE x <> 0)"""


@query(f"{_VECTORS} SELECT doc_id, term, round(w, 6) AS w FROM v")
def doc_vectors(spark, d):
    return vectors.document_vectors(_index(spark, d)).select("doc_id", "term", _r6("w").alias("w"))


@query(
    f"""{_VECTORS}, sim AS (SELECT a.doc_id AS query_id, b.doc_id, sum(a.w * b.w) AS x FROM v a JOIN v b USING (term) WHERE a.doc_id::BIGINT % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL),
a AS (SELECT x.doc_id AS query_id, y.doc_id, coalesce(sim.x, 0) AS score FROM d x, d y LEFT JOIN sim ON sim.query_id = x.doc_id AND sim.doc_id = y.doc_id WHERE x.doc_id::BIGINT % 20 = 0 AND x.doc_id <> y.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a)
SELECT {_shown} FROM r WHERE rank <= {K}"""
)
def more_like_this(spark, d):
    wanted = _table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return _show(vectors.similar_documents(_index(spark, d), wanted, K))


# --- Naive Bayes: all labelled rows train; only nb_accuracy holds some out ---

NB_SEED = 49
_TEXTS = f"""x AS (SELECT doc_id::VARCHAR AS doc_id, quality AS label, {_tok('text')} AS terms FROM documents JOIN labels USING (doc_id))"""
_HELD = f"""h AS (SELECT *, row_number() OVER (ORDER BY md5('{NB_SEED}:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER () * 0.2::DOUBLE, 0)) AS test FROM x)"""


def _nb_sql(train: str) -> str:
    return f"""c AS (SELECT label, count(*) AS n_docs, sum(len(terms)) AS n_tokens FROM {train} GROUP BY label),
t AS (SELECT label, term, count(*) AS cnt FROM (SELECT label, unnest(terms) AS term FROM {train}) GROUP BY ALL),
vs AS (SELECT count(DISTINCT term) AS v FROM t),
e AS (SELECT doc_id, unnest(terms) AS term FROM x),
sc AS (SELECT x.doc_id, c.label, ln(n_docs / (SELECT sum(n_docs) FROM c)::DOUBLE) + coalesce(sum(ln((coalesce(cnt, 0) + 1.0) / (n_tokens + v + 1))) FILTER (e.term IS NOT NULL), 0) AS score
  FROM x CROSS JOIN c CROSS JOIN vs LEFT JOIN e ON e.doc_id = x.doc_id LEFT JOIN t ON t.label = c.label AND t.term = e.term GROUP BY x.doc_id, c.label, n_docs),
pr AS (SELECT doc_id, label, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS p FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc) WINDOW w AS (PARTITION BY doc_id))"""


_NB = f"WITH {_TEXTS}, {_nb_sql('x')}"
_NB_HELD = f"WITH {_TEXTS}, {_HELD}, tn AS (SELECT * FROM h WHERE NOT test), {_nb_sql('tn')}"


def _nb(spark, d):
    rows = _labelled(spark, d)
    return rows, classify.fit(rows.select("text", "label"))


@query(f"{_NB} SELECT label, n_docs, n_tokens::BIGINT AS n_tokens, v FROM c, vs")
def nb_class_counts(spark, d):
    model = _nb(spark, d)[1]
    return model.classes.crossJoin(model.vocabulary)


@query(f"{_NB} SELECT doc_id, label, round(p, 6) AS p FROM pr")
def nb_predict(spark, d):
    rows, model = _nb(spark, d)
    return model.probabilities(rows.select("doc_id", "text")).select("doc_id", "label", _r6("p").alias("p"))


@query(
    f"""{_NB_HELD}, best AS (SELECT doc_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 12) DESC, label) AS n FROM pr) WHERE n = 1),
mj AS (SELECT label AS most FROM c ORDER BY n_docs DESC, label LIMIT 1)
SELECT round(avg((predicted = label)::INT), 6) AS accuracy, round(avg((most = label)::INT), 6) AS majority_accuracy FROM best JOIN h USING (doc_id), mj WHERE test"""
)
def nb_accuracy(spark, d):
    training, testing = classify.split(_labelled(spark, d), seed=NB_SEED)
    model = classify.fit(training.select("text", "label"))
    found = classify.accuracy(model.predict(testing.select("doc_id", "text")), testing.select("doc_id", "label"), training.select("label"))
    return found.select(*[_r6(c).alias(c) for c in found.columns])


@query(f"WITH {_TEXTS}, {_HELD} SELECT doc_id, test FROM h")
def nb_split(spark, d):
    parts = classify.split(_labelled(spark, d).select("doc_id"), seed=NB_SEED)
    return parts[0].withColumn("test", F.lit(False)).unionByName(parts[1].withColumn("test", F.lit(True)))


@query(f"{_NB} SELECT label, n_docs AS n FROM c ORDER BY n_docs DESC, label LIMIT 1")
def nb_majority(spark, d):
    return classify.majority(_labelled(spark, d).select("label"))


@query(f"{_NB} SELECT label, term, cnt, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, term) AS rank FROM t) WHERE rank <= {K}")
def top_words(spark, d):
    return _nb(spark, d)[1].top_words(K)


@query(f"""{_NB} SELECT label, term, cnt, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, term) AS rank FROM t)
  WHERE rank <= {K} AND label = (SELECT label FROM c ORDER BY n_docs DESC, label LIMIT 1)""")
def top_words_of_largest(spark, d):
    return _nb(spark, d)[1].top_words(K, classes=1)


# --- recommendations ---

_IX = """WITH i AS (SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS doc_id, max(ceil(l_quantity / 10))::INT AS rating
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
tr AS (SELECT * FROM i WHERE (user_id::BIGINT + doc_id::BIGINT) % 5 <> 0), te AS (SELECT * FROM i WHERE (user_id::BIGINT + doc_id::BIGINT) % 5 = 0),
items AS (SELECT DISTINCT p_partkey::VARCHAR AS doc_id FROM part),
pop AS (SELECT items.doc_id, count(tr.doc_id)::DOUBLE AS score FROM items LEFT JOIN tr USING (doc_id) GROUP BY items.doc_id)"""


def _split(spark, d, rows: DataFrame | None = None):
    """(training, testing) of ``rows``, the interactions; without them these are made and written once for both."""
    rows = cut(_interactions(spark, d)) if rows is None else rows
    test = (F.col("user_id").cast("long") + F.col("doc_id").cast("long")) % 5 == 0
    return rows.where(~test), rows.where(test)


def _items(spark, d) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id")).distinct()


@query(f"{_IX} SELECT items.doc_id, count(i.doc_id)::DOUBLE AS score FROM items LEFT JOIN i USING (doc_id) GROUP BY items.doc_id")
def popularity(spark, d):
    return recommend.popularity(_interactions(spark, d), _items(spark, d))


_POPULAR = f"""{_IX}, us AS (SELECT DISTINCT user_id FROM te),
cand AS (SELECT user_id, pop.doc_id, score FROM us, pop WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = us.user_id AND tr.doc_id = pop.doc_id)),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rank FROM cand) WHERE rank <= {K})"""


def _users(testing):
    return testing.select("user_id").distinct()


@query(f"{_POPULAR} SELECT user_id, doc_id, score, rank::INT AS rank FROM rk")
def popularity_unseen(spark, d):
    training, testing = _split(spark, d)
    return recommend.popular_unseen(_users(testing), training.select("user_id", "doc_id"), training, _items(spark, d), K)


_ROUTE = """rt AS (SELECT user_id, CASE WHEN n >= 5 THEN 'matrix_factorization' WHEN n > 0 AND liked THEN 'content' ELSE 'popularity' END AS strategy
  FROM (SELECT DISTINCT user_id FROM te) LEFT JOIN (SELECT user_id, count(*) AS n, bool_or(rating >= 4) AS liked FROM tr GROUP BY user_id) USING (user_id))"""


@query(f"{_IX}, {_ROUTE} SELECT user_id, strategy FROM rt")
def route_strategy(spark, d):
    training, testing = _split(spark, d)
    return recommend.route(testing.select("user_id"), training)


_READ = """hist AS (SELECT DISTINCT source AS user_id, doc_id::VARCHAR AS doc_id, (1 + n_chars % 5)::INT AS rating FROM documents)"""


def _reading(spark, d) -> DataFrame:
    """A reader for each source, who rates its documents by their length modulo 5."""
    return _table(spark, d, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("doc_id"), (1 + F.col("n_chars") % 5).cast("int").alias("rating")).distinct()


_PROFILE = f"""{_VECTORS}, {_READ},
ps AS (SELECT user_id, term, sum(w) AS x FROM hist JOIN v USING (doc_id) WHERE rating >= 4 GROUP BY ALL),
pf AS (SELECT user_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS w FROM ps)"""


@query(
    f"""{_PROFILE}, sc AS (SELECT user_id, doc_id, sum(pf.w * v.w) AS x FROM pf JOIN v USING (term) GROUP BY ALL),
a AS (SELECT u.user_id, d.doc_id, coalesce(x, 0) AS score FROM (SELECT DISTINCT user_id FROM pf) u CROSS JOIN d LEFT JOIN sc USING (user_id, doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = u.user_id AND h.doc_id = d.doc_id))
SELECT user_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a) WHERE rank <= {K}"""
)
def content_profile(spark, d):
    ix, history = _index(spark, d), _reading(spark, d)
    ranked = recommend.content_unseen(history, history, cut(vectors.document_vectors(ix)), ix.docs, K)
    return ranked.select("user_id", "doc_id", _r6("score").alias("score"), "rank")


# --- significance: BM25 against TF-IDF by NDCG ---

_PAIRED = f"""{_ASK}, {_ranked(_bm25(1.2, 0.75))}, {_ranked(_TFIDF, 't')}, {_QRELS}, {_metrics('r')},
{_metrics('t', 'm2').split(chr(10), 1)[1]},
df AS (SELECT query_id, m.ndcg - m2.ndcg AS d FROM m JOIN m2 USING (query_id))"""


def _differences(spark, d) -> DataFrame:
    ix, asked, rel = _index(spark, d), _queries(spark, d), cut(_qrels(spark, d))
    scores = [evaluation.per_query_ndcg(r.rank(asked, K), asked, rel, K).withColumnRenamed("ndcg", "score") for r in (ranking.Bm25(ix, 1.2, 0.75), ranking.TfIdf(ix))]
    return significance.paired(*scores).withColumn("d", F.round("d", 12))


@query(f"{_PAIRED} SELECT count(*) AS n, round(avg(round(d, 12)), 6) AS mean_difference, round(stddev_samp(round(d, 12)), 6) AS sd, count(*) FILTER (round(d, 12) > 0) AS wins_first, count(*) FILTER (round(d, 12) < 0) AS wins_second, count(*) FILTER (round(d, 12) = 0) AS ties FROM df")
def paired_summary(spark, d):
    return significance.summary(_differences(spark, d)).select("n", _r6("mean_difference").alias("mean_difference"), _r6("sd").alias("sd"), "wins_first", "wins_second", "ties")


@query(f"""{_PAIRED}, z AS (SELECT query_id, round(d, 12) AS d FROM df WHERE round(d, 12) <> 0)
SELECT query_id, round(d, 6) AS d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rank FROM z""")
def wilcoxon_ranks(spark, d):
    return significance.signed_ranks(_differences(spark, d)).select("query_id", _r6("d").alias("d"), "rank")


@query()
def bootstrap_ci(spark, d):
    rows = _differences(spark, d).orderBy("query_id").collect()
    import numpy as np

    low, high = significance.bootstrap_interval(np.array([r["d"] for r in rows] or [0.0]), seed=2026)
    return spark.createDataFrame([(low, high)], "low double, high double")


# --- factorization with parameters that are arithmetic of the ids ---

_FACTORS = 4


def _parameters(rows: DataFrame, key: str) -> DataFrame:
    n = F.col(key).cast("long")
    factors = F.array(*[((n * (j + 3) % 17) / 17.0 - 0.5) for j in range(_FACTORS)])
    return rows.select(key).distinct().select(key, ((n % 11) / 11.0 - 0.5).alias("bias"), factors.alias("factors"))


_bias = lambda c: f"(({c}::BIGINT % 11) / 11.0::DOUBLE - 0.5)"
_factor = lambda c, j: f"(({c}::BIGINT * {j + 3} % 17) / 17.0::DOUBLE - 0.5)"
_dot = " + ".join(f"{_factor('user_id', j)} * {_factor('doc_id', j)}" for j in range(_FACTORS))
_MF = f"{_IX}, mu AS (SELECT avg(rating) AS mu FROM tr), pd AS (SELECT i.*, mu + {_bias('user_id')} + {_bias('doc_id')} + {_dot} AS y FROM i, mu)"


def _mf(spark, d):
    rows = cut(_interactions(spark, d))
    training = _split(spark, d, rows)[0]
    mean = training.agg(F.avg("rating")).first()[0]
    return rows, _parameters(rows, "user_id"), _parameters(rows, "doc_id"), F.lit(mean)


@query(f"{_MF} SELECT user_id, doc_id, round(least(greatest(y, 1.0), 5.0), 6) AS predicted FROM pd")
def mf_predict(spark, d):
    return factorization.predicted(*_mf(spark, d), clip=True).select("user_id", "doc_id", _r6("predicted").alias("predicted"))


@query(f"{_MF} SELECT round(sqrt(avg((least(greatest(y, 1.0), 5.0) - rating) ** 2)), 6) AS rmse FROM pd")
def rmse(spark, d):
    rows = factorization.predicted(*_mf(spark, d), clip=True).withColumnRenamed("rating", "actual")
    return evaluation.rmse(rows).select(_r6("rmse").alias("rmse"))


# Item vectors of two equal terms, brand and type.
_ROUTED = f"""{_POPULAR}, {_ROUTE}, mu AS (SELECT avg(rating) AS mu FROM tr),
pv AS (SELECT DISTINCT p_partkey::VARCHAR AS doc_id, unnest([p_brand, p_type]) AS term, sqrt(0.5::DOUBLE) AS w FROM part),
ps AS (SELECT user_id, term, sum(w) AS x FROM tr JOIN pv USING (doc_id) JOIN rt USING (user_id) WHERE rating >= 4 AND strategy = 'content' GROUP BY ALL),
pf AS (SELECT user_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS w FROM ps),
cs AS (SELECT user_id, doc_id, sum(pf.w * pv.w) AS x FROM pf JOIN pv USING (term) GROUP BY ALL),
un AS (SELECT user_id, strategy, items.doc_id FROM rt, items WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = rt.user_id AND tr.doc_id = items.doc_id)),
sr AS (SELECT user_id, strategy, doc_id, round(CASE strategy WHEN 'matrix_factorization' THEN least(greatest(mu + {_bias('user_id')} + {_bias('doc_id')} + {_dot}, 1.0), 5.0)
  WHEN 'content' THEN CASE WHEN user_id IN (SELECT user_id FROM pf) THEN coalesce(x, 0) ELSE pop.score END ELSE pop.score END, 9) AS score
  FROM un JOIN pop USING (doc_id) LEFT JOIN cs USING (user_id, doc_id), mu),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rank FROM sr) WHERE rank <= {K})"""


def _routed(spark, d):
    rows = cut(_interactions(spark, d))
    training, testing = _split(spark, d, rows)
    users = _parameters(rows, "user_id")
    mean = training.agg(F.avg("rating")).first()[0]
    every = _parameters(_items(spark, d), "doc_id")
    model = factorization.Model(users, every, mean, [], [])
    parts = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.explode(F.array("p_brand", "p_type")).alias("term"), F.sqrt(F.lit(0.5)).alias("w")).distinct()
    return training, testing, recommend.recommend(_users(testing), training, training, _items(spark, d), parts, model, K)


@query(f"{_ROUTED} SELECT user_id, strategy, doc_id, rank::INT AS rank FROM rr")
def routed_recommend(spark, d):
    """Every test user's list by the user's own route; model parameters are arithmetic of the ids."""
    return _routed(spark, d)[2].select("user_id", "strategy", "doc_id", "rank")


@query(
    f"""{_ROUTED}, hits AS (SELECT rr.user_id, count(*) AS hits FROM rr JOIN te ON te.user_id = rr.user_id AND te.doc_id = rr.doc_id AND te.rating >= 4 GROUP BY rr.user_id)
SELECT strategy, round(avg(coalesce(hits, 0) / {K}::DOUBLE), 6) AS precision FROM rt LEFT JOIN hits USING (user_id) GROUP BY strategy"""
)
def strategy_precision(spark, d):
    training, testing, ranked = _routed(spark, d)
    routed = recommend.route(testing.select("user_id"), training)
    return recommend.strategy_precision(ranked, routed, testing, K).select("strategy", _r6("precision").alias("precision"))


_square = " + ".join(f"{_factor(c, j)} ** 2" for c in ("user_id", "doc_id") for j in range(_FACTORS))


@query(f"{_MF} SELECT round(avg((y - rating) ** 2) / 2 + 0.03 / 2 * avg({_square} + {_bias('user_id')} ** 2 + {_bias('doc_id')} ** 2), 6) AS loss FROM pd")
def mf_loss(spark, d):
    return factorization.loss(*_mf(spark, d), 0.03).select(_r6("loss").alias("loss"))


_gradient = ", ".join(f"round(sum((y - rating) * {_factor('doc_id', j)} + 0.03 * {_factor('user_id', j)}) / (SELECT count(*) FROM pd), 9) AS g{j}" for j in range(_FACTORS))


@query(f"{_MF} SELECT user_id, round(sum(y - rating + 0.03 * {_bias('user_id')}) / (SELECT count(*) FROM pd), 9) AS g_bias, {_gradient} FROM pd GROUP BY user_id")
def mf_gradient(spark, d):
    of_users, _ = factorization.gradients(*_mf(spark, d), 0.03)
    return of_users.select("user_id", F.round("g_bias", 9).alias("g_bias"), *[F.round(F.col("g_factors")[j], 9).alias(f"g{j}") for j in range(_FACTORS)])


# --- clustering: one round from centroids of given documents ---

_CENTRES = f"""{_VECTORS}, cd AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS topic FROM (SELECT DISTINCT doc_id FROM v) QUALIFY topic < 8),
ce AS (SELECT topic, term, w FROM cd JOIN v USING (doc_id)),
sm AS (SELECT v.doc_id, topic, round(sum(v.w * ce.w), 9) AS x FROM v JOIN ce USING (term) GROUP BY ALL),
asg AS (SELECT d.doc_id, coalesce(topic, 0) AS topic FROM d LEFT JOIN (SELECT * FROM sm WHERE x > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, topic) = 1) USING (doc_id))"""


def _centres(spark, d):
    ix = _index(spark, d)
    v = cut(vectors.document_vectors(ix))
    first = v.select("doc_id").distinct().orderBy("doc_id").limit(8).withColumn("topic", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("int"))
    return ix, v, v.join(first, "doc_id").select("topic", "term", "w")


@query(f"{_CENTRES} SELECT doc_id, topic FROM asg")
def cluster_assign(spark, d):
    ix, v, centres = _centres(spark, d)
    return cluster.assign(v, centres, ix.docs)


@query(f"{_CENTRES}, u AS (SELECT topic, term, sum(w) AS x FROM v JOIN asg USING (doc_id) GROUP BY ALL) SELECT topic, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY topic)), 6) AS w FROM u")
def centroid_update(spark, d):
    ix, v, centres = _centres(spark, d)
    return cluster.update(v, cluster.assign(v, centres, ix.docs), centres).select("topic", "term", _r6("w").alias("w"))


# --- beyond SQL ---


@query()
def spherical_kmeans(spark, d):
    ix = _index(spark, d)
    return cluster.spherical_kmeans(vectors.document_vectors(ix), ix.docs)[0]


_DRAWS = 600
_digest = lambda *keys: "('0x' || substr(md5(" + " || ':' || ".join(keys) + "), 1, 15))::BIGINT"


@query(
    f"""{_IX}, ni AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM items),
dr AS (SELECT user_id, {_digest("'42'", "user_id", "j::VARCHAR")} % (SELECT count(*) FROM items) + 1 AS place, min(j) AS j
  FROM (SELECT DISTINCT user_id FROM te), range(1, {_DRAWS}) v(j) GROUP BY ALL)
SELECT user_id, doc_id, 0.0::DOUBLE AS score, rank::INT AS rank FROM (SELECT user_id, doc_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS rank
  FROM dr JOIN ni USING (place) WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = dr.user_id AND tr.doc_id = ni.doc_id)) WHERE rank <= {K}"""
)
def random_recommend(spark, d):
    training, testing = _split(spark, d)
    return recommend.random_unseen(_users(testing), training.select("user_id", "doc_id"), _items(spark, d), K)


@query(
    f"""{_IX}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || doc_id), doc_id) AS place FROM i)
SELECT user_id, doc_id, rating, CASE WHEN place <= CASE WHEN n < 2 THEN 0 ELSE least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0))) END THEN 'test' ELSE 'train' END AS part FROM n"""
)
def random_split(spark, d):
    training, testing = recommend.split_by_user(cut(_interactions(spark, d)))
    return training.withColumn("part", F.lit("train")).unionByName(testing.withColumn("part", F.lit("test")))


@query()
def synthetic_interactions(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 12).cast("int").alias("topic"))
    return synthetic.synthetic_ratings(spark, docs)[0]


@query()
def mf_fit(spark, d):
    model = factorization.fit(_interactions(spark, d))
    return spark.createDataFrame(list(enumerate(model.losses, 1)), "epoch int, loss double")


@query()
def mf_recommend(spark, d):
    training, testing = _split(spark, d)
    users, items = _users(training.unionByName(testing)), _items(spark, d)
    model = factorization.fit(training, user_ids=users, item_ids=items)
    return recommend.factor_unseen(_users(testing), training.select("user_id", "doc_id"), items, model, K)
