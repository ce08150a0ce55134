import random

import pytest

from gridspark.llm import leakage
from gridspark.llm.leakage import LeakFinder, leaks

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string, split string"
rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(40)]


def sentence(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute(doc, item, n=15):
    d, w = doc.lower().replace(",", " ").split(), item.lower().split()
    grams = {tuple(d[i: i + n]) for i in range(len(d) - n + 1)}
    return any(tuple(w[i: i + n]) in grams for i in range(len(w) - n + 1))


def test_like_brute_force():
    items = [(i, sentence(rng.randint(5, 60))) for i in range(30)]
    docs = []
    for _ in range(300):
        w = rng.choice(items)[1].split()
        n = rng.randint(10, 20)
        a = rng.randint(0, max(0, len(w) - n))
        docs.append(f"{sentence(rng.randint(0, 30))} {', '.join(w[a: a + n]).upper()} {sentence(rng.randint(0, 30))}")
    f = LeakFinder(items)
    hits = 0
    for d in docs:
        want = {i for i, t in items if brute(d, t)}
        assert {f.items[n][0] for n in f.find(d)} == want
        hits += len(want)
    assert hits > 50


@pytest.mark.parametrize("chars", [leakage.AUTOMATON_CHARS, 100])
def test_spark_with_dirt(spark, monkeypatch, chars):
    monkeypatch.setattr(leakage, "AUTOMATON_CHARS", chars)
    t = " ".join(f"word{i}" for i in range(30))
    items = [(1, t, None), (2, "too short", "x"), (3, None, "x"), (None, t, "x"), (4, t + "\n\nand a question?", "x"), (4, t + "\n\nand a question?", "x")]
    leaked = "''x'' " + " ".join(f"[[p|word{i}]]<ref>r</ref>" for i in range(3, 18)) + " end"
    docs = [(10, leaked, "clash"), (11, " ".join(f"word{i}" for i in range(14)), ""), (12, None, ""), (13, "", ""), (None, t, ""), (14, "pre" + t + " x" * 200_000, "")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = [tuple(r) for r in leaks(d, i).collect()]
    assert sorted(got) == [(10, 1), (10, 4), (14, 1), (14, 4)]
    w = {(r["doc_id"], r["item_id"]): r for r in leaks(d, i, where=True).collect()}
    r = w[10, 1]
    assert r["n_words"] == 15 and leaked[r["start"]: r["end"]].startswith("word3]]") and leaked[r["start"]: r["end"]].endswith("word17")
    assert w[14, 1]["n_words"] == 29


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaks(d, i).count() == 0
    assert leaks(spark.createDataFrame([(1, "x", "")], DOCS), i).count() == 0
