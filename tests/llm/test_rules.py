import re
from collections import Counter

from lexivane.llm import rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_metrics_against_brute_force(make, edge):
    rows = [*edge, (200, "a b a b a b a", "s"), (201, "p q r p q r", "s"), (202, "#*$%&|<> x", "s")]
    got = rules.judge(make(rows), keep_columns=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_keeps_clean_and_drops_junk(make, words):
    clean = " ".join(f"the {a} of {b}" for a, b in zip(words[:200], words[200:400], strict=True))
    junk = {
        2: " ".join(w + "***" for w in clean.split()),
        3: clean.upper().replace(" ", "!! "),
        4: " | ".join(clean.split()),
        5: " ".join(words[:300]),
        6: " ".join(w for w in words[:40] for _ in range(9)),
        7: "\n".join(["the same line of text", *clean.split()[:3]] * 60),
    }
    docs = make([(1, clean, "s"), *((i, t, "s") for i, t in junk.items())])
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, clean, "en", "s", len(clean), "S", "W", "R", "K")]


def test_rule_table_is_a_parameter(make, words):
    docs = make([(1, " ".join(words[:300]), "s")])
    assert rules.keep_good(docs, rules=()).count() == 1
    assert rules.keep_good(docs, rules=(rules.Rule("long", "n_words", "n_words", high=(1, 2)),)).count() == 0


def test_empty_table(make):
    assert rules.judge(make([])).count() == rules.keep_good(make([])).count() == 0


def test_plan_is_one_map(make, edge):
    plan = rules.judge(make(edge))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python")
