import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lexivane.llm import decontam

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(t):
    return re.findall(PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=13):
    windows = set()
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        windows |= {(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    out = []
    for _, t in docs:
        w, hit, who = split(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    who.add(i)
        out.append((len(w), len(hit), sorted(who)))
    return out


@pytest.fixture(scope="module")
def items(spark, words):
    long = [(k, " ".join(words[20 * k : 20 * k + 18])) for k in range(12)]
    rows = [*long, (50, "Éa, two-three"), (51, ""), (52, None), (53, "dup dup dup"), (54, "dup dup dup"), (55, " ".join(words[:18])), (10, "?!")]
    return rows, spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, extra int")


@pytest.fixture(scope="module")
def rows(edge, words):
    passage = lambda k, a=0, b=18: " ".join(words[20 * k + a : 20 * k + b])
    return [
        *edge,
        (200, f"Before {passage(1).upper()}; after", "a"),
        (201, " ".join(words[600:800]) + " " + passage(2, 1, 16) + " " + " ".join(words[300:500]), "a"),
        (202, passage(3, 0, 12), "a"),
        (203, "Éa-TWO\nthree and ÉA two three", "a"),
        (204, "dup dup dup dup dup x dup dup", "b"),
        (205, " ".join(words[600:880]) + " " + passage(4) + ", tail. " + " ".join(words[600:880]), "b"),
        (206, passage(0) + " " + passage(5) + " " + passage(0), None),
    ]


@pytest.mark.parametrize("limit", [100_000, 20])
def test_hits_against_brute_force(make, rows, items, limit):
    docs = make(rows)
    got = decontam.find_hits(docs.select(F.col("doc_id").alias("key"), "text"), items[1], limit=limit).withColumn("n_hit", decontam.n_hit()).collect()
    want = brute([(i, t) for i, t, _ in rows], items[0])
    found = sorted((str(r["key"]), r["n_words"], r["n_hit"], r["items"]) for r in got)
    assert found == sorted((str(i), n, h, w) for (i, _, _), (n, h, w) in zip(rows, want, strict=True))
    for r in got:
        flat = [x for s in r["runs"] for x in (s["start"], s["end"])]
        assert flat == sorted(set(flat))


@pytest.mark.parametrize("limit", [100_000, 20])
def test_decontaminate(make, rows, items, limit):
    docs = make(rows)
    out = decontam.decontaminate(docs, items[1], limit=limit)
    assert out.columns == docs.columns
    got = out.collect()
    dirty = {i for (i, t, _), (n, h, _) in zip(rows, brute([(i, t) for i, t, _ in rows], items[0]), strict=True) if h and 20 * h >= n}
    assert dirty == {200, 203, 204, 206}
    assert not dirty & {r["doc_id"] for r in got} and len(got) == len(rows) - len(dirty)
    text = {r["doc_id"]: r for r in got}
    old = {i: t for i, t, _ in rows}
    assert text[201]["text"] == old[201].replace(" ".join(items[0][2][1].split()[1:16]), "") and text[201]["n_chars"] == len(text[201]["text"])
    assert brute([(1, text[205]["text"])], items[0])[0][1] == 0 and text[205]["text"].endswith(", tail. " + old[205].split(", tail. ")[1])
    assert all(r["text"] == old[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] not in (201, 205))


def test_names_are_the_callers(spark, make, rows, items):
    """Columns with the names that the larger path joins by come back as they were."""
    names = ("_h", "_n", "_r", "h", "n", "r", "row", "runs")
    docs = make(rows).selectExpr("doc_id", "text", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    small, large = ({(r["doc_id"], r["text"]): r for r in decontam.decontaminate(docs, items[1], limit=n).collect()} for n in (100_000, 20))
    assert set(small) == set(large)
    assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for out in (small, large) for r in out.values() for c in names)


def test_windows_of_very_many_items_and_very_long_words(spark, words):
    passage = " ".join(words[:13])
    rows = [(str(i), passage) for i in range(300)] + [("long", "x" * 50_000 + " " + "y" * 50_000)]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    docs = spark.createDataFrame([(1, "a " + passage + " b"), (2, rows[-1][1]), (3, "clean text")], "key long, text string")
    got = [{r["key"]: (r["n_words"], sorted(r["items"]), [tuple(x) for x in r["runs"]]) for r in decontam.find_hits(docs, bench, limit=n).collect()} for n in (100_000, 40)]
    assert got[0] == got[1] == {1: (15, sorted(str(i) for i in range(300)), [(1, 14)]), 2: (2, ["long"], [(0, 2)]), 3: (2, [], [])}
    assert decontam._blocks(bench, 13, 40)[0] >= 8


def test_empty_tables(make, edge, items):
    assert decontam.decontaminate(make([]), items[1]).count() == 0
    docs = make(edge)
    assert decontam.decontaminate(docs, items[1].where("false")).count() == len(edge)


def test_query_digest(spark, tmp_path, make, rows, items):
    from lexivane.llm.queries import QUERIES

    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    items[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op6_decontaminate"](spark, str(tmp_path)).collect()}
    assert (got[204]["n_items"], got[204]["items_sha256"]) == (2, hashlib.sha256(b"53,54").hexdigest())
    assert got[206]["items_sha256"] == hashlib.sha256(b"0,5,55").hexdigest() and got[206]["contaminated"]
    assert got[201]["n_hit"] == 15 and not got[201]["contaminated"]
