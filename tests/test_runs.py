"""Whole runs, their reports and charts, and the command line, on small tables."""

import json
import random
import xml.dom.minidom

import pytest

from lexivane import __main__ as cli
from lexivane.functions.text import tokenizer
from lexivane.operators import factorization, ranking
from lexivane.operators.index import build_index, store
from lexivane.plans import charts, reports, runs

PLAIN = tokenizer(())


@pytest.fixture(scope="module")
def corpus(spark):
    """Four topics of eight words each; a document is of one topic."""
    rng = random.Random(2)
    words = [[f"t{t}w{k}" for k in range(8)] for t in range(4)]
    rows = [(f"d{n:03d}", "", " ".join(rng.choice(words[n % 4]) for _ in range(12))) for n in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id string, title string, body string")


@pytest.fixture(scope="module")
def asked(spark, corpus):
    rows = corpus[0]
    queries = spark.createDataFrame([(f"q{n}", rows[n][2][:30]) for n in range(12)] + [("none", "zzz")], "query_id string, text string")
    qrels = spark.createDataFrame([(f"q{n}", rows[m][0]) for n in range(12) for m in (n, n + 4)], "query_id string, doc_id string")
    return queries, qrels


def test_evaluation_run(corpus, asked, tmp_path):
    index = build_index(corpus[1], PLAIN)
    found = runs.run_evaluation(index, *asked, str(tmp_path))
    assert len(found["grid"]) == 12 and found["best"] == max(found["grid"], key=lambda p: p[5])[:2]
    assert [r[0] for r in found["rankers"]] == ["TF-IDF", "BM25"] and all(r[5] > 0 for r in found["rankers"])
    text = (tmp_path / "evaluation.md").read_text()
    assert all(x in text for x in ("# Evaluation", "## BM25 grid", "## Paired comparison", "TF-IDF"))
    xml.dom.minidom.parse(str(tmp_path / "bm25-grid.svg"))
    assert reports.grid_report(found["grid"]).count("\n") == 13
    with pytest.raises(ValueError):
        reports.evaluate_rankers(index, asked[0], asked[1].where("false"), {"x": ranking.TfIdf(index)})


def test_significance_section_replaces_itself(corpus, asked, tmp_path):
    path = tmp_path / "report.md"
    path.write_text("# Report\n\nKept.\n\n## Paired comparison\n\nold\n")
    index = store(build_index(corpus[1], PLAIN), str(tmp_path / "ix"))
    found = runs.run_significance(index, *asked, str(path))
    assert found.n == 12 and found.wins_first + found.wins_second + found.ties == 12
    text = path.read_text()
    assert text.startswith("# Report\n\nKept.") and "old" not in text and text.count("## Paired comparison") == 1


def test_benchmark_run(spark):
    rows = spark.range(1_000).selectExpr("concat('d', id) as doc_id", "'' as title", "concat('alpha', id % 7, ' beta', id % 5, ' gamma and delta') as body")
    found = runs.run_benchmarks(rows, 2)
    assert (found.documents, found.prefix) == (1_000, "al") and set(found.queries) == {"single term", "AND", "OR", "NOT", "nested"}
    text = found.report()
    assert "Index build (1,000 documents)" in text and "nested query" in text and "`al`" in text
    with pytest.raises(ValueError):
        runs.run_benchmarks(rows, 0)
    with pytest.raises(ValueError):
        runs.run_benchmarks(rows.limit(10), 2)


def test_recommender_run(corpus, tmp_path):
    settings = factorization.Settings(n_factors=3, epochs=2)
    index = build_index(corpus[1], PLAIN)
    found = runs.run_recommenders(index, str(tmp_path), users=12, ratings=10, topics=4, rounds=2, settings=settings, sizes=(0, 1, 5))
    assert [r[0] for r in found["strategies"]] == ["matrix_factorization", "popularity", "random"]
    assert [r[1] is None for r in found["strategies"]] == [False, True, True]
    assert {s for s, *_ in found["cold_start"]} == {0, 1, 5} and found["cold_start"][0][1] == "popularity"
    assert 0 <= found["majority_accuracy"] <= 1 and found["training_accuracy"] > found["majority_accuracy"] / 2
    assert len(found["topic_words"]) == 3 and all(len(w) == 8 or len(w) == 10 for w in found["topic_words"].values())
    assert len(found["losses"]) == len(found["validation_losses"]) == 2
    text = (tmp_path / "recommenders.md").read_text()
    assert text == "## Recommenders on synthetic ratings\n\n" + found["report"] + "\n" and "### Short histories" in text
    for name in ("loss.svg", "cold-start.svg"):
        xml.dom.minidom.parse(str(tmp_path / name))


def test_charts_of_little():
    for svg in (charts.lines({}, "x", "y"), charts.lines({"a<b": [(1, 2)]}, "x", "y"), charts.heat_map({(1, 2): 0.5}, "k", "b", "t & u")):
        xml.dom.minidom.parseString(svg)


def test_tables_and_small_helpers(spark):
    assert reports.cold_start_table([(3, "content", 0.0125)]).endswith("| 3 | content | 0.013 |") or reports.cold_start_table([(3, "content", 0.0125)]).endswith("| 3 | content | 0.012 |")
    assert "N/A" in reports.recommender_table([("random", None, 0.1, 0.2)])
    calls = []
    assert reports.average_seconds(calls.append, ["a", "b"]) >= 0 and calls == ["a", "b"]
    vocabulary = spark.createDataFrame([(w,) for w in ("and", "Not", "or", "ore", "sea")], "term string")
    assert sorted(r["term"] for r in reports.searchable_terms(vocabulary).collect()) == ["ore", "sea"]


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "c.jsonl"
    source.write_text("\n".join(json.dumps({"_id": f"d{k}", "title": "", "text": t}) for k, t in enumerate(["fog at sea", "fog on land", "sun"])))
    assert cli.main(["download", source.as_uri(), "--output", str(tmp_path / "copy.jsonl")]) == 0
    assert cli.main(["index", str(tmp_path / "copy.jsonl"), "--output", str(tmp_path / "ix")]) == 0
    capsys.readouterr()
    assert cli.main(["search", str(tmp_path / "ix"), "fog AND NOT sea", "--ranker", "boolean"]) == 0
    assert capsys.readouterr().out == "d1\n"
    assert cli.main(["search", str(tmp_path / "ix"), "sea fog", "-k", "1"]) == 0
    assert capsys.readouterr().out.startswith("d0\t")
    assert cli.main([]) == 0 and "download" in capsys.readouterr().out
