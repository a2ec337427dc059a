import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivane.functions.tables import numbered
from lexivane.functions.text import tokenizer
from lexivane.operators import classify, cluster, evaluation, factorization, recommend, synthetic, vectors
from lexivane.operators.index import build_index

PLAIN = tokenizer(())


def ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id string, doc_id string, rating int")


def ids(spark, names, column="doc_id"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def test_naive_bayes(spark):
    model = classify.fit(spark.createDataFrame([("apple apple", 0), ("banana", 1)], "text string, label int"), tokenizer=PLAIN)
    texts = spark.createDataFrame([("a", "apple"), ("n", ""), ("u", "unseen")], "doc_id string, text string")
    p = {(r["doc_id"], r["label"]): r["p"] for r in model.probabilities(texts).collect()}
    assert (p["a", 0], p["a", 1]) == pytest.approx((12 / 17, 5 / 17))
    assert p["n", 0] == pytest.approx(0.5)
    assert {r["doc_id"]: r["predicted"] for r in model.predict(texts).collect()} == {"a": 0, "n": 0, "u": 1}
    assert [r["term"] for r in model.top_words(1).orderBy("label").collect()] == ["apple", "banana"]
    with pytest.raises(ValueError):
        classify.fit(spark.createDataFrame([], "text string, label int"))


def test_naive_bayes_accuracy(spark):
    train = spark.createDataFrame([("apple", 0), ("apple pie", 0), ("banana", 1), ("banana split", 1)], "text string, label int")
    test = spark.createDataFrame([("a", "apple", 0), ("b", "banana", 1)], "doc_id string, text string, label int")
    found = classify.accuracy(classify.fit(train).predict(test.select("doc_id", "text")), test.select("doc_id", "label"), train).first()
    assert tuple(found) == (1.0, 0.5)


def test_kmeans(spark):
    unit = lambda x, y: (x / math.hypot(x, y), y / math.hypot(x, y))
    points = {"d1": unit(1, 0), "d2": unit(0.9, 0.1), "d3": unit(0, 1), "d4": unit(0.1, 0.9)}
    v = spark.createDataFrame([(d, t, float(w)) for d, p in points.items() for t, w in zip("xy", p, strict=True) if w], "doc_id string, term string, w double")
    universe = ids(spark, [*points, "empty"])
    for seed in (1, 2):
        topics = {r["doc_id"]: r["topic"] for r in cluster.spherical_kmeans(v, universe, 2, 3, seed)[0].collect()}
        if topics["d1"] != topics["d3"]:
            break
    assert topics["d1"] == topics["d2"] != topics["d3"] == topics["d4"] and topics["empty"] == 0
    with pytest.raises(ValueError):
        cluster.seeds(v, universe, 6, 1)
    with pytest.raises(ValueError):
        cluster.seeds(v, universe, 5, 1)
    with pytest.raises(ValueError):
        cluster.spherical_kmeans(v, universe, 2, 0)


ROWS = [("u1", "d1", 5), ("u1", "d2", 4), ("u2", "d1", 4), ("u2", "d2", 1)]


def test_factorization_learns_and_repeats(spark):
    s = factorization.Settings(n_factors=3, rate=0.05, epochs=20, batch=2, seed=7)
    a, b = (factorization.fit(ratings(spark, ROWS), s, validation=ratings(spark, ROWS[:1])) for _ in range(2))
    assert a.losses == b.losses and a.losses[-1] < a.losses[0] and len(a.validation_losses) == 20
    assert all(1 <= r["predicted"] <= 5 for r in a.predict(ratings(spark, ROWS)).collect())
    with pytest.raises(ValueError):
        factorization.fit(ratings(spark, []))


def test_gradients_against_differences(spark):
    rng = np.random.default_rng(1)
    make = lambda key, names: {n: (float(rng.normal()), rng.normal(size=2).tolist()) for n in names}
    u, i, rows = make("u", ["u1", "u2"]), make("i", ["d1", "d2"]), ratings(spark, ROWS)
    frame = lambda key, p: spark.createDataFrame([(n, b, f) for n, (b, f) in p.items()], f"{key} string, bias double, factors array<double>")
    users, items, mean = frame("user_id", u), frame("doc_id", i), F.lit(3.5)
    of_users, of_items = factorization.gradients(rows, users, items, mean, 0.1)

    def loss():
        total = 0.0
        for a, d, r in ROWS:
            e = 3.5 + u[a][0] + i[d][0] + sum(x * y for x, y in zip(u[a][1], i[d][1], strict=True)) - r
            total += e * e + 0.1 * (u[a][0] ** 2 + i[d][0] ** 2 + sum(x * x for x in u[a][1] + i[d][1]))
        return total / (2 * len(ROWS))

    assert factorization.loss(rows, users, items, mean, 0.1).first()[0] == pytest.approx(loss())
    for table, params, key in ((of_users, u, "user_id"), (of_items, i, "doc_id")):
        for r in table.collect():
            for k in range(2):
                old, h = params[r[key]][1][k], 1e-6
                params[r[key]][1][k] = old + h
                up = loss()
                params[r[key]][1][k] = old - h
                down = loss()
                params[r[key]][1][k] = old
                assert r["g_factors"][k] == pytest.approx((up - down) / (2 * h), abs=1e-5)
    # The mini-batch trainer takes the same step.
    U = np.array([[*u[n][1], u[n][0], 1.0] for n in ("u1", "u2")])
    Q = np.array([[*i[n][1], 1.0, i[n][0]] for n in ("d1", "d2")])
    before = U.copy()
    s = factorization.Settings(n_factors=2, rate=0.01, reg=0.1)
    factorization.batch_step(U, Q, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([r[2] - 3.5 for r in ROWS]), s)
    want = {r["user_id"]: [*r["g_factors"], r["g_bias"], 0.0] for r in of_users.collect()}
    assert (before - U) / 0.01 == pytest.approx(np.array([want["u1"], want["u2"]]))


def test_split_and_prefixes(spark):
    rows = ratings(spark, [("u1", f"d{k}", 3) for k in range(5)] + [("u2", f"d{k}", 3) for k in range(4)] + [("u3", "d1", 3)] + [("u4", f"d{k:02d}", 3) for k in range(12)])
    train, test = recommend.split_by_user(rows)
    assert {r["user_id"]: r["count"] for r in test.groupBy("user_id").count().collect()} == {"u1": 1, "u2": 1, "u4": 2}
    assert train.count() + test.count() == rows.count() and train.intersect(test).count() == 0
    with pytest.raises(ValueError):
        recommend.split_by_user(rows, 1.0)
    one, three = ({tuple(r)[:2] for r in recommend.history_prefix(rows, n).collect()} for n in (1, 3))
    assert one < three and len(one) == 4


TEXTS = [("d1", "red apple fruit", ""), ("d2", "red apple juice", ""), ("d3", "blue ocean", ""), ("d4", "green leaf", ""), ("d5", "deep water", ""), ("d6", "stone", ""), ("d7", "cloud", ""), ("d8", "", "")]


def test_routes_and_recommendations(spark):
    items = ids(spark, [d for d, _, _ in TEXTS])
    index = build_index(spark.createDataFrame(TEXTS, "doc_id string, title string, body string"), PLAIN)
    v = vectors.document_vectors(index)
    training = ratings(spark, [(f"t{k}", "d3", 4) for k in range(8)] + [("t0", "d2", 4), ("t1", "d2", 3)])
    history = ratings(spark, [("liker", "d1", 5), ("hater", "d1", 1), ("hater", "d3", 2), ("blank", "d8", 5)] + [("many", f"d{k}", 3) for k in range(1, 6)])
    users = ids(spark, ["new", "liker", "hater", "blank", "many"], "user_id")
    assert {r["user_id"]: r["strategy"] for r in recommend.route(users, history).collect()} == {"new": "popularity", "liker": "content", "hater": "popularity", "blank": "content", "many": "matrix_factorization"}
    model = factorization.fit(history.unionByName(training), factorization.Settings(n_factors=2, epochs=2), item_ids=[d for d, _, _ in TEXTS])
    got = {}
    for r in recommend.recommend(users, history, training, items, v, model, 3).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["doc_id"])
    assert got["new"] == ["d3", "d2", "d1"]
    assert got["liker"] == ["d2", "d3", "d4"]
    assert got["hater"] == ["d2", "d4", "d5"]
    assert got["blank"] == ["d3", "d2", "d1"]
    assert sorted(got["many"]) == ["d6", "d7", "d8"]
    with pytest.raises(RuntimeError):
        recommend.recommend(users, history, training, items, v, None)


def test_random_is_seeded_and_unseen(spark):
    items, users = ids(spark, [f"d{k}" for k in range(9)]), ids(spark, ["a", "b"], "user_id")
    seen = ratings(spark, [("a", "d1", 3)]).select("user_id", "doc_id")
    runs = [{(r["user_id"], r["rank"]): r["doc_id"] for r in recommend.random_unseen(users, seen, items, 8, s).collect()} for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]
    left = [f"d{k}" for k in range(9) if k != 1]
    assert sorted(runs[0]["a", n] for n in range(1, 9)) == left
    assert recommend.random_unseen(users, seen, items, 0).count() == 0


def test_random_draws_until_nobody_is_short(spark):
    """A user who has seen all but a few items gets those; one who has seen all gets none."""
    items = ids(spark, [f"d{k:03d}" for k in range(300)])
    rows = [("most", f"d{k:03d}", 3) for k in range(300) if k not in (7, 200, 299)] + [("all", f"d{k:03d}", 3) for k in range(300)] + [("few", "d001", 3)]
    seen = ratings(spark, rows).select("user_id", "doc_id")
    users = ids(spark, ["most", "all", "few", "new"], "user_id")
    got = {}
    for r in recommend.random_unseen(users, seen, items, 10, 3).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["doc_id"])
    assert sorted(got["most"]) == ["d007", "d200", "d299"] and "all" not in got
    assert len(set(got["few"])) == len(set(got["new"])) == 10 and got["few"] != got["new"] and "d001" not in got["few"]
    # Each by itself as in company.
    alone = recommend.random_unseen(users.where("user_id = 'few'"), seen, items, 10, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in alone] == got["few"]


def test_blocks_of_items_give_the_same_lists(spark, monkeypatch):
    items, users = ids(spark, [f"d{k:02d}" for k in range(23)]), ids(spark, ["a", "b", "c"], "user_id")
    rows = ratings(spark, [("a", "d01", 5), ("a", "d02", 1), ("b", "d03", 4), ("c", "d22", 2)])
    model = factorization.fit(rows, factorization.Settings(n_factors=2, epochs=1), item_ids=[f"d{k:02d}" for k in range(23)])
    run = lambda: [tuple(r) for r in recommend.factor_unseen(users, rows.select("user_id", "doc_id"), items, model, 6).orderBy("user_id", "rank").collect()]
    whole = run()
    monkeypatch.setattr(recommend, "BLOCK_ITEMS", 7)
    assert run() == whole and len(whole) == 18


def test_unknown_ids_and_empty_errors_raise(spark):
    rows = ratings(spark, [("u", "d", 5), ("v", "e", 2)])
    model = factorization.fit(rows, factorization.Settings(n_factors=2, epochs=1))
    for bad in (("x", "d", 1), ("u", "x", 1)):
        with pytest.raises(Exception, match="unknown"):
            model.predict(ratings(spark, [bad])).collect()
    with pytest.raises(Exception, match="unknown"):
        recommend.factor_unseen(ids(spark, ["u"], "user_id"), rows.select("user_id", "doc_id"), ids(spark, ["x"]), model, 3).collect()
    with pytest.raises(ValueError):
        evaluation.rmse(spark.createDataFrame([], "actual double, predicted double"))
    twice = spark.createDataFrame([("d1", 0), ("d1", 1)], "doc_id string, topic int")
    with pytest.raises(ValueError):
        recommend.align_topics(ids(spark, ["d1"]), twice)


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([((k * 7919) % 5000, k % 3) for k in range(5000)], "a int, b int").repartition(7)
    got = sorted((r["place"], r["a"]) for r in numbered(rows, "a").collect())
    assert got == [(k + 1, k) for k in range(5000)]
    down = {r["a"]: r["place"] for r in numbered(rows, F.desc("a")).collect()}
    assert down[4999] == 1 and down[0] == 5000
    equal = spark.range(5000).selectExpr("1 as a", "id")
    assert sorted(r["place"] for r in numbered(equal, "a", "id").collect()) == list(range(1, 5001))
    assert numbered(rows.where("false"), "a").count() == 0


def test_document_split(spark):
    rows = spark.createDataFrame([(f"d{k}", f"text {k}") for k in range(12)], "doc_id string, text string")
    train, test = classify.split(rows, 0.2, 5)
    assert test.count() == 2 and train.count() == 10 and train.columns == rows.columns
    assert {r[0] for r in test.collect()} == {r[0] for r in classify.split(rows.repartition(3), 0.2, 5)[1].collect()}


def test_words_of_the_largest_classes(spark):
    rows = [("a a b", 0), ("c", 1), ("c d", 1), ("e", 2), ("f", 2)]
    model = classify.fit(spark.createDataFrame(rows, "text string, label int"), tokenizer=PLAIN)
    got = [(r["label"], r["term"]) for r in model.top_words(1, classes=2).orderBy("label").collect()]
    assert got == [(1, "c"), (2, "e")]


def test_compare_strategies(spark):
    training = ratings(spark, [("u1", "d1", 5), ("u1", "d2", 2), ("u2", "d1", 4), ("u2", "d3", 5), ("u3", "d3", 1), ("u3", "d4", 4)])
    testing = ratings(spark, [("u1", "d3", 5), ("u2", "d2", 4), ("u3", "d1", 2)])
    items = ids(spark, ["d1", "d2", "d3", "d4"])
    model = factorization.fit(training, factorization.Settings(n_factors=2, epochs=2), item_ids=["d1", "d2", "d3", "d4"])
    got = {r["strategy"]: r for r in recommend.compare_strategies(training, testing, items, model, 2).collect()}
    assert set(got) == {"popularity", "random", "matrix_factorization"}
    assert got["popularity"]["rmse"] is None and got["matrix_factorization"]["rmse"] > 0
    assert got["popularity"]["precision"] == pytest.approx(2 / 6) and got["popularity"]["recall"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        recommend.compare_strategies(training, testing.where("false"), items, model)


def test_cold_start_and_alignment(spark):
    items = ids(spark, [d for d, _, _ in TEXTS])
    v = vectors.document_vectors(build_index(spark.createDataFrame(TEXTS, "doc_id string, title string, body string"), PLAIN))
    rows = ratings(spark, [(f"u{k}", f"d{(k + j) % 8 + 1}", 1 + (k + j) % 5) for k in range(6) for j in range(7)])
    train, test = recommend.split_by_user(rows)
    fit = lambda x, s: factorization.fit(x, factorization.Settings(n_factors=2, epochs=1, seed=s), item_ids=[d for d, _, _ in TEXTS])
    got = recommend.cold_start(v, items, train, test, fit, sizes=(0, 5)).collect()
    assert [(r["history_size"], r["strategy"]) for r in got] == [(0, "popularity"), (5, "matrix_factorization")]
    topics = spark.createDataFrame([(d, k) for k, (d, _, _) in enumerate(TEXTS)], "doc_id string, topic int")
    assert {r["doc_id"]: r["topic"] for r in recommend.align_topics(items, topics).collect()}["d3"] == 2
    with pytest.raises(ValueError):
        recommend.align_topics(items, topics.where("doc_id <> 'd3'"))


def test_synthetic(spark):
    docs = spark.createDataFrame([(f"d{k:02d}", k % 3) for k in range(30)], "doc_id string, topic int")
    first, liked = synthetic.synthetic_ratings(spark, docs, 6, 8, 5)
    again, _ = synthetic.synthetic_ratings(spark, docs, 6, 8, 5)
    rows = first.collect()
    assert sorted(rows) == sorted(again.collect()) and len({(r["user_id"], r["doc_id"]) for r in rows}) == 48
    assert {r["rating"] for r in rows} <= {1, 2, 3, 4, 5} and liked.count() == 6
    joined = first.join(docs, "doc_id").join(liked, "user_id").withColumn("p", F.array_contains("topics", F.col("topic")))
    mean = {r["p"]: r["m"] for r in joined.groupBy("p").agg(F.avg("rating").alias("m")).collect()}
    assert mean[True] > mean.get(False, 0)
    for bad in ((0, 8), (6, 0), (6, 31)):
        with pytest.raises(ValueError):
            synthetic.synthetic_ratings(spark, docs, *bad)
