import os
import random

import pytest

from gridspark.llm import mixing
from gridspark.llm.mixing import TOKENIZER, Mix, fluid_finish, token_counter
from gridspark.llm.registry import oracle_sql, queries
from tests.util import rows, run_sql

DOCS = "doc_id bigint, source string, text string, tokens string, copy string"
TARGETS = "source string, target_share double, max_repeats int, own_tokens string"
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")


def corpus(spark, n=300):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c"]), "word " * rng.randint(1, 60), "clash", "clash") for i in range(n)]
    rows += [(n, None, "no source " * 5, "", ""), (n + 1, "z", "no target " * 5, "", ""), (n + 2, "a", None, "", ""), (None, "b", "no id", "", ""), (2**53 + 1, "b", "wide id", "", ""), (n + 3, "a", "", "", ""), (5, "a", "repeated id", "", ""), (5, "a", "repeated id", "", "")]
    return spark.createDataFrame(rows, DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


def test_token_counter():
    c = token_counter()
    assert c("hello world") == 2 and c("<|endoftext|>") > 1


@pytest.mark.parametrize("piece", [7, 50, 1_000_000])
def test_cut_texts_have_the_same_tokens(monkeypatch, piece):
    """Cutting changes no count, whatever the text and the size of the pieces."""
    import base64

    import tiktoken

    monkeypatch.setattr(mixing, "PIECE", piece)
    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("r", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng, c = random.Random(7), token_counter()
    kinds = ["word", " ", "  ", "\n", " \n ", "'s", "'", "12", "é", "\u3000", "\u00a0x", "--", ".", "\t", "\x1c", "\u200b", "日本"]
    for _ in range(60):
        t = "".join(rng.choice(kinds) for _ in range(rng.randint(1, 150)))
        assert c(t) == len(whole(t))
    for run in (" " * 1500, "\n" * 1500, " \n" * 800, "\u3000" * 1200):
        for t in (run, "a" + run, run + "a", "a" + run + "b" + run, run + "12 " + run):
            assert c(t) == len(whole(t))


def test_very_long_texts():
    c = token_counter()
    assert c("some line\n" * 250_000) == 250_000 * c("some line\n")
    assert c(" " * 2_000_000) > 0 and c("x" + "\n" * 1_000_000 + "y") > 2 and c("a" * 1_500_000) > 0



@pytest.mark.parametrize("buckets", [1, 8, 1024])
def test_like_one_ordered_queue(spark, monkeypatch, buckets):
    """The mix is the longest prefix, by finish time, that fits the budget; whatever the number of buckets."""
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    m = Mix(corpus(spark), targets(spark, [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 2), ("d", 0.1, 3), ("none", None, None)]), budget=4000)
    q = sorted((r["finish"], r["source"], r["doc_id"], r["copy"], r["tokens"]) for r in m.queue.collect())
    want, total = [], 0
    for x in q:
        if total + x[4] > 4000:
            break
        want.append(x)
        total += x[4]
    got = [(r["finish"], r["source"], r["doc_id"], r["copy"], r["tokens"]) for r in m.chosen.collect()]
    assert got == want and total > 3900
    # finish times are the source's running totals over its weight
    own = {r["source"]: r["own_tokens"] for r in m.targets.collect()}
    for s, w in (("a", 0.3), ("b", 0.3)):
        run = 0
        for f, src, _, copy, t in q:
            if src == s:
                run += t
                assert f == pytest.approx(run / w) and (copy - 1) * own[s] < run + 1e-9


def exact_mix(m):
    q = sorted(((r["finish"], r["source"], -1 if r["doc_id"] is None else r["doc_id"], r["copy"], r["tokens"]) for r in m.queue.collect()))
    want, total = [], 0
    for x in q:
        if total + x[4] > m.budget:
            break
        want.append(x)
        total += x[4]
    return want


@pytest.mark.parametrize("share_of_total", [0.01, 0.5, 1.0, 2.0])
@pytest.mark.parametrize(("few", "buckets"), [(100_000, 1024), (2, 4)])
def test_budgets(spark, monkeypatch, share_of_total, few, buckets):
    """Any budget, with a huge document whose band holds many small ones, and ranges cut again and again."""
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    docs = corpus(spark).union(spark.createDataFrame([(9000, "b", "huge " * 3000, "", ""), *[(9100 + i, "a", "", "", "") for i in range(40)]], DOCS))
    rows = [("a", 0.5, 100), ("b", 0.4, 3), ("c", 0.1, 2)]
    total = Mix(docs, targets(spark, rows), budget=0).total
    m = Mix(docs, targets(spark, rows), budget=int(total * share_of_total))
    got = [(r["finish"], r["source"], -1 if r["doc_id"] is None else r["doc_id"], r["copy"], r["tokens"]) for r in m.chosen.collect()]
    assert got == exact_mix(m)
    own = {r["source"]: r["own_tokens"] for r in m.targets.collect()}
    assert {x["source"] for x in m.short.collect()} == {s for s, w, k in rows if w * m.total > k * own[s]}


def test_a_small_budget_makes_nobody_short(spark):
    docs = spark.createDataFrame([(i, s, "word " * 40, "", "") for i, s in enumerate("ab" * 25)], DOCS)
    m = Mix(docs.filter("source = 'b' OR doc_id < 4"), targets(spark, [("a", 0.5, 100), ("b", 0.5, 100)]), budget=400)
    assert m.short.count() == 0 and all(r["reached"] for r in m.report.collect())


def test_report(spark):
    m = Mix(corpus(spark), targets(spark, [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.39, 2), ("d", 0.01, 3)]))
    r = {x["source"]: x for x in m.report.collect()}
    used = sum(x["used_tokens"] for x in r.values())
    assert m.total - 61 <= used <= m.total and sum(x["actual_share"] for x in r.values()) == pytest.approx(1)
    assert {2**53 + 1, None} <= {x["doc_id"] for x in m.queue.collect()}
    assert all(x["used_tokens"] <= x["max_repeats"] * x["own_tokens"] and x["used_repeats"] <= x["max_repeats"] for x in r.values())
    want = {s for s, w, k in (("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.39, 2), ("d", 0.01, 3)) if w * m.total > k * (r[s]["own_tokens"])}
    assert {x["source"] for x in m.short.collect()} == want == {"c", "d"}
    assert not r["c"]["reached"] and r["a"]["reached"]
    assert r["c"]["used_repeats"] == 2


@pytest.mark.parametrize(("budget", "double"), [(40, 1), (0, 1), (None, 2), (None, 1)])
def test_short_whatever_the_budget(spark, budget, double):
    """Copies that are not made because the budget is full, or because the shares sum to 2, still count."""
    rows = [("a", 0.3 * double, 3), ("b", 0.3 * double, 3), ("c", 0.4 * double, 9), ("d", 0.0, 3), ("e", 0.01, 2**31 - 1), ("z", 0.01, 0)]
    m = Mix(corpus(spark), targets(spark, rows), budget=budget)
    own = {r["source"]: r["own_tokens"] for r in m.targets.collect()}
    want = {s for s, w, k in rows if w * m.total > k * own[s]}
    assert {x["source"] for x in m.short.collect()} == want == {x["source"] for x in m.report.collect() if not x["reached"]}
    assert "a" not in want and {"e", "z"} <= want


def served(docs, rows, total):
    """Tokens of each source in a fair queue of single documents, one after the other, until the budget is full."""
    sent, at = dict.fromkeys((s for s, _, _ in rows), 0), dict.fromkeys((s for s, _, _ in rows), 0)
    left = {s: [t for d, t in docs if d == s] * k for s, _, k in rows}
    weight = {s: w for s, w, _ in rows}
    while True:
        ready = [s for s in left if at[s] < len(left[s]) and weight[s] > 0]
        if not ready:
            return sent
        s = min(ready, key=lambda s: (sent[s] + left[s][at[s]]) / weight[s])
        if sum(sent.values()) + left[s][at[s]] > total:
            return sent
        sent[s], at[s] = sent[s] + left[s][at[s]], at[s] + 1


@pytest.mark.parametrize(("seed", "budget"), [(0, None), (1, 7)])
def test_short_like_a_simulated_queue(spark, seed, budget):
    """Sources short in a queue that takes document after document are those of the mix, and of the sizes alone."""
    rng = random.Random(seed)
    docs = [(s, 2 * rng.randint(1, 20)) for s in "abcdef" for _ in range(rng.randint(1, 6))]
    shares = [rng.random() for _ in "abcdef"]
    rows = [(s, w / sum(shares), rng.randint(1, 4)) for s, w in zip("abcdef", shares)]
    m = Mix(spark.createDataFrame([(i, s, "a1" * (t // 2), "", "") for i, (s, t) in enumerate(docs)], DOCS), targets(spark, rows), budget=budget)
    total = sum(t for _, t in docs)
    sent, own = served(docs, rows, total), {s: sum(t for d, t in docs if d == s) for s, _, _ in rows}
    want = {s for s, w, k in rows if sent[s] == k * own[s] < w * total}
    assert m.total == total and {x["source"] for x in m.short.collect()} == want == {x["source"] for x in m.reach.collect() if not x["reached"]}


def test_short_is_read_from_the_mix(spark, monkeypatch):
    """Queue, range sort and cut decide: what they lose is no longer served."""
    docs = spark.createDataFrame([(i, s, "a1" * n, "", "") for i, (s, n) in enumerate([("a", 2), ("a", 3), ("b", 45)])], DOCS)
    rows = [("a", 0.5, 2), ("b", 0.5, 9)]
    assert [x["source"] for x in Mix(docs, targets(spark, rows)).short.collect()] == ["a"]
    with monkeypatch.context() as m:
        queue = Mix._queue
        m.setattr(Mix, "_queue", lambda self, *x: queue(self, *x).filter("copy = 1"))
        assert Mix(docs, targets(spark, rows)).short.count() == 0
    with monkeypatch.context() as m:
        m.setattr(Mix, "_limit", lambda self, q: q.orderBy("finish").select(*mixing.ORDER).first())
        assert Mix(docs, targets(spark, rows)).short.count() == 0
    sorted_copies = []
    with monkeypatch.context() as m:
        m.setattr(Mix, "_limit", lambda self, q: sorted_copies.append([tuple(r[c] for c in mixing.ORDER) for r in q.collect()]))
        Mix(docs, targets(spark, rows)).short.collect()
    assert len(sorted_copies[0]) > 4 and sorted_copies[0] == sorted(sorted_copies[0])


@pytest.mark.parametrize(("share", "own", "total"), [(0.34, 17, 50), (0.81, 243, 300), (float("nan"), 20, 50)])
def test_short_at_the_limit_like_sql(spark, tmp_path, share, own, total):
    """Exactly enough, give or take the rounding of the share: as SQL multiplies, for texts of as many tokens as characters."""
    texts = [(1, "a", ("a1" * own)[:own]), (2, "b", ("a1" * total)[: total - own])]
    docs = spark.createDataFrame([(*t, "", "") for t in texts], DOCS)
    t = targets(spark, [("a", share, 1), ("b", 0.1, 1)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    t.write.parquet(str(tmp_path / "mix_targets.parquet"))
    for name in ("p8_found", "p8_reach"):
        assert rows(queries()[name](spark, str(tmp_path)).toPandas()) == rows(run_sql(oracle_sql()[name], str(tmp_path)))


def test_everything_runs_dry(spark):
    m = Mix(corpus(spark, 50), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), budget=10**9)
    assert m.full_at == float("inf") and m.chosen.count() == m.queue.count()


def test_fluid():
    s = [{"weight": 0.5, "cap": 10}, {"weight": 0.5, "cap": 100}]
    assert fluid_finish(s, 10) == pytest.approx(10) and fluid_finish(s, 20) == pytest.approx(20) and fluid_finish(s, 30) == pytest.approx(40)
    assert fluid_finish(s, 1000) == float("inf") and fluid_finish([], 1) == float("inf")


def test_empty(spark):
    m = Mix(spark.createDataFrame([], DOCS), targets(spark, [("a", 1.0, 1)]))
    assert m.chosen.count() == 0 and m.report.count() == 1
    m = Mix(corpus(spark, 5), spark.createDataFrame([], TARGETS))
    assert m.chosen.count() == 0 and m.short.count() == 0
