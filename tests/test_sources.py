import json
import zipfile

import pytest

from lexivane.sources import readers
from lexivane.streaming.ingest import index_stream, load_index


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_corpus(spark, tmp_path):
    good = lines(tmp_path / "a.jsonl", ["", {"text": "Two boats left.", "_id": "log-7", "wind": "NW", "title": "Dawn"}, " \t ", {"_id": "log-8", "title": "", "text": ""}])
    assert sorted(map(tuple, readers.read_corpus(spark, good).collect())) == [("log-7", "Dawn", "Two boats left."), ("log-8", "", "")]
    for bad in ([{"_id": "x", "title": "t"}], ["{broken"]):
        with pytest.raises(Exception):
            readers.read_corpus(spark, lines(tmp_path / "b.jsonl", bad)).collect()


def test_queries_last_line_counts(spark, tmp_path):
    path = lines(tmp_path / "q.jsonl", [{"_id": "31", "text": "tide"}, {"_id": "32", "text": "fog"}, "", {"_id": "31", "text": "ebb"}])
    assert {r["query_id"]: r["text"] for r in readers.read_queries(spark, path).collect()} == {"31": "ebb", "32": "fog"}


def test_qrels(spark, tmp_path):
    rows = ["Query-ID\tdoc\tgrade", "31\tlog-7\t3", "31\tlog-8\t0", "", " 32 \t log-9 \t 1 ", "QUERY-ID\tonly two", "33\tlog-7\t-2", "31\tlog-7\t1", '34\t"log ""ten"""\t1', '"35"\t"log\televen"\t1']
    path = lines(tmp_path / "t.tsv", rows)
    want = [("31", "log-7"), ("32", "log-9"), ("34", 'log "ten"'), ("35", "log\televen")]
    assert sorted(map(tuple, readers.read_qrels(spark, path).collect())) == want
    for bad in ("31\tlog-7", "31\tlog-7\t1\tx", "31\tlog-7\t1\tx\ty"):
        with pytest.raises(Exception, match="three cells"):
            readers.read_qrels(spark, lines(tmp_path / "u.tsv", ["31\tlog-8\t1", bad])).collect()
    with pytest.raises(Exception):
        readers.read_qrels(spark, lines(tmp_path / "v.tsv", ["31\tlog-8\tmany"])).collect()
    both = readers.merge_qrels(readers.read_qrels(spark, path), spark.createDataFrame([("31", "log-7"), ("39", "log-1")], "query_id string, doc_id string"))
    assert both.count() == 5


def test_archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for m in ("corpus.jsonl", "queries.jsonl", "qrels/train.tsv", "qrels/test.tsv"):
            z.writestr(f"set/{m}", m)
    got = readers.extract_archive(str(tmp_path / "x.zip"), str(tmp_path / "out"), "set/")
    assert open(got["train"]).read() == "qrels/train.tsv"


def test_download_keeps_nothing_partial(tmp_path):
    source, target = tmp_path / "s.bin", tmp_path / "t.bin"
    source.write_bytes(b"data")
    assert readers.download(source.as_uri(), str(target)) == str(target) and target.read_bytes() == b"data"
    with pytest.raises(Exception):
        readers.download((tmp_path / "none").as_uri(), str(tmp_path / "u.bin"))
    assert not list(tmp_path.glob("*.part")) and not (tmp_path / "u.bin").exists()


def test_csv(spark, tmp_path):
    row = ("BM25", "k1=1.2", 0.5, 0.25, 0.75, 0.125, 3.5, "extra")
    names = [*readers.RESULT_COLUMNS, "note"]
    table = spark.createDataFrame([row], names)
    readers.write_results_csv(table.select(*[f"`{c}`" for c in reversed(names)]), str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("part-*.csv")).read_text() == ",".join(readers.RESULT_COLUMNS) + "\nBM25,k1=1.2,0.5,0.25,0.75,0.125,3.5\n"
    with pytest.raises(ValueError):
        readers.write_results_csv(table.drop("MRR"), str(tmp_path / "s"))


def test_stream_makes_versions(spark, tmp_path):
    schema = "doc_id string, title string, body string"
    for n, word in enumerate(("alpha", "beta")):
        spark.createDataFrame([(f"d{n}", "", word)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = index_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "cp"))
        assert q.awaitTermination(60)
    assert load_index(spark, str(tmp_path / "ix")).num_docs() == 2
    assert load_index(spark, str(tmp_path / "ix"), 1).num_docs() == 1
