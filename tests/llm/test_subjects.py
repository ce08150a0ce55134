import random

import numpy as np
import pytest

from gridspark.llm.subjects import PAGE, PER_SUBJECT, Chain, fit_logistic, page_kind, page_units, subject_areas, train

DOCS = "doc_id bigint, text string, source string, subject string"
LABELS = "doc_id bigint, subject string, annotator string"
TERMS = {"law": "court judge verdict appeal statute clause".split(), "music": "chord ballad sonata tempo violin choir".split(), "sport": "league coach referee goal cup match".split()}
SUBJECTS = sorted(TERMS)
PLAIN = "the of and in a was by after when most little remains letter from names gives no year according to".split()


def sentence(rng, s=None, n=2):
    w = [rng.choice(PLAIN) for _ in range(9)] + ([rng.choice(TERMS[s]) for _ in range(n)] if s else [])
    rng.shuffle(w)
    return " ".join(w) + "."


def paragraph(rng, s):
    return " ".join(sentence(rng, s) for _ in range(3)) + " " + sentence(rng)


def table(rng, s):
    cells = [" || ".join(rng.choice(TERMS[s] + PLAIN[:2]) for _ in range(3)) for _ in range(4)]
    return '{| class="x"\n! the !! of\n|-\n| ' + "\n|-\n| ".join(cells) + "\n|}"


def page(rng):
    """(text, its lasting subjects)"""
    own = rng.sample(SUBJECTS, rng.choice([1, 1, 2]))
    kind = rng.random()
    if kind < 0.15:  # a stub
        return sentence(rng, own[0]), {own[0]}
    parts = [paragraph(rng, s) for s in own for _ in range(2)]
    if kind < 0.4:  # one subject has but a table
        parts[-2:] = [paragraph(rng, None), table(rng, own[-1])]
    passing = rng.choice([s for s in SUBJECTS if s not in own])
    parts[0] += " " + sentence(rng, passing, 1)
    return "\n\n".join(parts), set(own)


def sample(n, seed):
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]


def dead_pages(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.choice(SUBJECTS)
        out.append(rng.choice([f"#REDIRECT [[{rng.choice(TERMS[s])}]]", "\n".join(f":{sentence(rng, s)} ~~~~" for _ in range(4)), "\n\n".join("qq zz " * 20 + paragraph(rng, s)[:40] for _ in range(2))]))
    return out


def fitted(noise=0.08, own_of=lambda own, text: own):
    rng = random.Random(9)
    docs = sample(250, 1)
    labels = [{SUBJECTS.index(x) for x in own_of(own, t)} for t, own in docs]
    noisy = [{rng.randrange(3)} if rng.random() < noise else (set(list(x)[:1]) if rng.random() < noise else x) for x in labels]
    return train([t for t, _ in docs], ["s"] * 250, noisy, SUBJECTS, [(t, "s") for t in dead_pages(60, 5)])


def held_out():
    test = sample(200, 2)
    return [t for t, _ in test], np.array([[s in own for s in SUBJECTS] for _, own in test])


def test_held_out_accuracy():
    m, (texts, want) = fitted(), held_out()
    assert (m.classify(texts, ["s"] * 200) == want).mean() > 0.97
    nothing = [*dead_pages(20, 8), "#REDIRECT [[Court]]", ":court judge verdict ~~~~\n:appeal court judge ~~~~", "qq zz " * 20 + "court judge", "", None, " ".join(PLAIN)]
    assert m.classify(nothing, ["s"] * len(nothing)).any(1).mean() < 0.05
    rng = random.Random(12)
    assert m.classify(["\n\n".join([paragraph(rng, None)] * 3 + [table(rng, "law")])], ["s"])[0].tolist() == [True, False, False]
    assert m.classify(["The court and the judge of a verdict."], ["s"])[0].tolist() == [True, False, False]


def test_disabling_the_chain_costs_precision(monkeypatch):
    """Without the chain's decision any evidence of a subject would count, passing paragraphs included."""
    rng = random.Random(3)
    m = fitted()
    texts, want = held_out()
    # every second page has one paragraph about something else
    other = [[s for j, s in enumerate(SUBJECTS) if not row[j]] for row in want]
    texts = [t + "\n\n" + paragraph(rng, rng.choice(o)) if i % 2 and o else t for i, (t, o) in enumerate(zip(texts, other))]
    full = m.classify(texts, ["s"] * 200)
    evidence = lambda self, x, sources, beam=8: np.stack([x[:, s * len(PER_SUBJECT)] + x[:, s * len(PER_SUBJECT) + 3] > 0 for s in range(self.k)], 1)
    monkeypatch.setattr(Chain, "decode", evidence)
    bare = m.classify(texts, ["s"] * 200)
    precision = lambda y: (y & want).sum() / y.sum()
    recall = (full & want).sum() / want.sum()
    assert (full != bare).any() and recall >= 0.9 and precision(full) >= precision(bare) + 0.1


def test_labels_overrule_any_fixed_notion_of_lasting():
    """Where annotators also mark single paragraphs, the chain gives them: it has no rule of its own."""
    rng = random.Random(4)
    make = lambda s: [" ".join([paragraph(rng, s)]) + "\n\n" + "\n\n".join(" ".join(sentence(rng) for _ in range(4)) for _ in range(4)) for _ in range(1)][0]
    subjects = [rng.choice(SUBJECTS) for _ in range(200)]
    m = train([make(s) for s in subjects], ["s"] * 200, [{SUBJECTS.index(s)} for s in subjects], SUBJECTS)
    got = m.classify([make(s) for s in subjects], ["s"] * 200)
    assert np.mean([row[SUBJECTS.index(s)] for row, s in zip(got, subjects)]) >= 0.9


def test_chain_learns_co_occurrence():
    """The second label follows the first, its own features say nothing."""
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.5
    y = np.stack([first, first & (rng.random(600) < 0.95)], 1).astype(float)
    x = np.zeros((600, 2 * len(PER_SUBJECT) + len(PAGE)))
    x[:, 0] = first
    c = Chain(x, y, np.zeros((600, 0)))
    got = c.decode(x, np.zeros((600, 0)))
    assert (got[:, 0] == first).all() and (got[:, 1] == first).mean() > 0.95


def test_beam_of_one_against_all():
    rng = np.random.default_rng(1)
    y = (rng.random((300, 3)) < 0.5).astype(float)
    x = np.concatenate([np.repeat(y, len(PER_SUBJECT), 1) * 0.5 + rng.normal(0, 1, (300, 3 * len(PER_SUBJECT))), np.zeros((300, len(PAGE)))], 1)
    c, none = Chain(x, y, np.zeros((300, 0))), np.zeros((300, 0))
    assert (c.decode(x, none, 8) == c.decode(x, none, 64)).all()  # eight labellings of three subjects
    assert c.decode(x, none, 1).shape == (300, 3)


def test_logistic():
    x = np.linspace(-2, 2, 200)[:, None]
    w = fit_logistic(x, (x[:, 0] > 0).astype(float), 0.01)
    assert abs(w[0]) < 0.2 and w[1] > 5


def test_page_parts():
    p, t = page_units("== H ==\npara one\n\npara two\n{|\n| a || b\n|}\n\n[[Category:X]]")
    assert [x.split() for x in p] == [["para", "one"], ["para", "two"]] and [x.split() for x in t] == [["a", "b"]]
    assert [page_kind(x) for x in ("#redirect [[x]]", " #WEITERLEITUNG[[x]]", "text", ":a ~~~~\n::b")] == ["redirect", "redirect", "page", "talk"]


def test_spark_with_dirt(spark):
    docs = sample(120, 4)
    rows = [(i, t, "s" if i % 3 else None, "clash") for i, (t, _) in enumerate(docs)] + [(500, None, "s", ""), (501, "", "s", ""), (None, docs[0][0], "s", ""), (502, "x " * 300_000, "s", ""), (3, docs[3][0], "s", "")]
    labels = [(i, s.upper() + " " if i % 5 == 0 else s, "a") for i, (_, own) in enumerate(docs) for s in own] + [(1, None, "b"), (None, "law", "b"), (2, "astrology", "b"), (0, next(iter(docs[0][1])), "c")]
    subjects = spark.createDataFrame([(s, "g") for s in SUBJECTS] + [(None, "g"), ("law", "g")], "subject string, gloss string")
    got = subject_areas(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), subjects).collect()
    found = {(r["doc_id"], r["subject"]) for r in got}
    want = {(i, s) for i, (_, own) in enumerate(docs) for s in own}
    assert len(found ^ want) < 0.05 * len(want)


@pytest.mark.parametrize("labels", [[], [(99, "law", "a")]])
def test_empty(spark, labels):
    subjects = spark.createDataFrame([(s, "g") for s in SUBJECTS], "subject string, gloss string")
    lab = spark.createDataFrame(labels, LABELS)
    assert subject_areas(spark.createDataFrame([], DOCS), lab, subjects).count() == 0
    assert subject_areas(spark.createDataFrame([(1, "court", "s", "")], DOCS), lab, subjects).count() == 0


def test_every_source_has_its_own_feature():
    docs = sample(160, 6)
    names = [f"s{i % 80:02}" for i in range(160)]
    m = train([t for t, _ in docs], [*names[:-1], None], [{SUBJECTS.index(x) for x in own} for _, own in docs], SUBJECTS)
    one = m.source_columns([*sorted(set(names)), None, "new"])
    assert one.shape == (82, 80) and (one[:80] == np.eye(80)).all() and not one[80:].any()
    assert m.classify([t for t, _ in docs[:5]], names[75:80]).shape == (5, 3)


def test_too_many_subjects(spark):
    subjects = spark.range(1001).selectExpr("concat('s', id) AS subject", "'g' AS gloss")
    with pytest.raises(ValueError, match="more than 1000 subjects"):
        subject_areas(spark.createDataFrame([(1, "court", "s", "")], DOCS), spark.createDataFrame([], LABELS), subjects)
