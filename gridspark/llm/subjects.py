"""Subject areas of documents: classifier chains over term, source and structure features, decoded by beam search.

1. *Terms.* From the labelled documents, an expectation-maximisation over their sentences learns which words speak
   for which subject against the language at large (a sentence belongs to one of its document's labels or to none),
   so passing remarks and neutral prose don't blur the weights.
2. *Features* per document and subject: how many paragraphs and tables are mainly about it, its words and their share,
   whether it leads, also on a short page; per document its length, its source, and whether it is a redirect, a talk
   page or a page of few ordinary words.
3. *Chain.* One calibrated logistic model per subject, in the order of their frequency, each also sees the decisions
   before it, so the co-occurrence of subjects counts; a beam search decodes the most likely combination. What makes a
   subject a lasting part of a page is learnt from the labels; nothing overrules the chain's answer.
4. *Pages without a subject.* Annotators label pages that have one, so redirects, talk pages and nonsense are missing
   among the labels; such pages of a bounded sample of all documents join the training with no label.

Training uses at most ``MAX_LABELLED`` labelled documents and ``MAX_PLAIN`` others (``MAX_LABELLED_CHARS`` characters
in all), chosen by hash; every
document is classified, over its whole text, where it lies, without a shuffle. The model sent to the executors is as
large as the vocabulary of that sample (terms found in at least ``MIN_DOCS`` of its documents). Every source of the
sample is a feature of its own; more than ``MAX_SUBJECTS`` subjects are an error.

Defined results: labels are compared without case and spaces, unknown subjects and NULLs ignored, repeated ones count
once; NULL or empty texts have no subject; without any usable label, or on an empty table, the result is empty;
repeated documents give repeated rows per document row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.shared import broadcast_model
from gridspark.llm.wikitext import render, words
from gridspark.session import cut_lineage

MAX_LABELLED, MAX_PLAIN, MAX_LABELLED_CHARS = 8000, 2000, 40_000_000
MAX_SUBJECTS = 1000
MIN_DOCS = 3
STUB_WORDS = 60
BEAM = 8
TERM_SHARE = 0.35
#: a word is ordinary if this share of the labelled documents has it; a page with fewer than NONSENSE of them is nonsense
ORDINARY, NONSENSE = 0.01, 0.3

_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_HEADING = re.compile(r"^[ \t]*=+[^\n]*=+[ \t]*$", re.M)
_BLANK = re.compile(r"\n[ \t]*\n")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n")
_REDIRECT = re.compile(r"\s*#\s*(?:redirect|weiterleitung|redirección|redireccion)\b", re.I)
_SIGNED = re.compile(r"^\s*:|~~~~|\[\[\s*(?:user|benutzer|usuario)\b|\{\{\s*(?:unsigned|ping)\b", re.I)


def page_units(text: str) -> tuple[list[str], list[str]]:
    """(visible paragraphs, visible tables) of a page."""
    tables = [render(t) for t in _TABLE.findall(text)] if "{|" in text else []
    rest = render(_TABLE.sub("\n\n", text) if tables else text)
    return [p for p in _BLANK.split(_HEADING.sub("\n\n", rest)) if p.strip()], tables


def page_kind(text: str) -> str:
    """``redirect``, ``talk`` or ``page``."""
    if _REDIRECT.match(text):
        return "redirect"
    lines = [x for x in text.split("\n") if x.strip()]
    return "talk" if lines and 2 * sum(bool(_SIGNED.search(x)) for x in lines) >= len(lines) else "page"


# --- terms ----------------------------------------------------------------------------------------------------

def learn_terms(texts: list[str], labels: list[set[int]], k: int, rounds: int = 8) -> tuple[dict[str, np.ndarray], frozenset[str]]:
    """(word -> log weight for each of ``k`` subjects, for words that speak for one; words of ordinary language)."""
    sentences, allowed, docs_with, labelled_with = [], [], Counter(), Counter()
    for text, own in zip(texts, labels):
        seen: set[str] = set()
        paragraphs, tables = page_units(text)
        for s in [s for p in paragraphs for s in _SENTENCE.split(p)] + tables:
            w = words(s).split()
            if w:
                sentences.append(w)
                allowed.append(own)
                seen.update(w)
        docs_with.update(seen)
        labelled_with.update((w, s) for w in seen for s in own)
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in docs_with.items() if n >= MIN_DOCS))}
    ordinary = frozenset(w for w, n in docs_with.items() if n >= max(MIN_DOCS, ORDINARY * len(texts)))
    ids = [np.array([vocab[w] for w in s if w in vocab]) for s in sentences]
    use = [i for i, x in enumerate(ids) if len(x)]
    if not use:
        return {}, ordinary
    size = np.array([len(ids[i]) for i in use])
    tok, at, first = np.concatenate([ids[i] for i in use]), np.repeat(np.arange(len(use)), size), np.append(0, np.cumsum(size)[:-1])
    may = np.zeros((k, len(use)), bool)
    for j, i in enumerate(use):
        may[list(allowed[i]), j] = True
    # a word can only speak for a subject if the documents that have it mostly carry its label; function words of a
    # rare language and nonsense don't, however unlike the language at large they are
    base = np.array([sum(s in own for own in labels) for s in range(k)]) / len(labels)
    pure = np.zeros((k, len(vocab)), bool)
    for w, i in vocab.items():
        for s in range(k):
            pure[s, i] = labelled_with[w, s] / (docs_with[w] + 2) >= max(0.3, 1.6 * base[s])
    none = np.ones(len(use))
    count = lambda x: np.bincount(tok, x, len(vocab))
    topic = np.stack([count((may[s] / np.maximum(may.sum(0), 1))[at]) for s in range(k)]) * 0.5 * pure + 0.05
    back = count(0.5 * none[at]) + 0.05
    for _ in range(rounds):
        p, b = topic / topic.sum(1, keepdims=True), back / back.sum()
        mix = TERM_SHARE * p + (1 - TERM_SHARE) * b
        ratio, own = np.log(mix) - np.log(b), TERM_SHARE * p / mix
        like = np.stack([np.add.reduceat(ratio[s][tok], first) for s in range(k)]) + np.log(0.8) - np.log(np.maximum(may.sum(0), 1))
        like = np.vstack([np.where(may, like, -np.inf), np.full(len(use), np.log(0.2))])
        like -= like.max(0)
        post = np.exp(like)
        post /= post.sum(0)
        topic = np.stack([count(post[s][at] * own[s][tok]) for s in range(k)]) * pure
        back = count(none[at]) - topic.sum(0)
        topic, back = topic + 0.02, np.maximum(back, 0) + 0.02
    p, b = topic / topic.sum(1, keepdims=True), back / back.sum()
    w = np.log(TERM_SHARE * p + (1 - TERM_SHARE) * b) - np.log(b)
    w = np.where(pure, w, np.minimum(w, 0.0))
    keep = w.max(0) > 1.0
    return {t: w[:, i] for t, i in vocab.items() if keep[i]}, ordinary


# --- features -------------------------------------------------------------------------------------------------

#: features of one subject on one page; the page's own come after all subjects'
PER_SUBJECT = ("paragraph", "paragraphs", "more_paragraphs", "table", "tables", "words", "share", "leads", "short_leads", "short_only")
PAGE = ("short", "long", "mostly_table", "redirect", "talk", "nonsense")
#: the features that tell a page that can't have a subject
DEAD = slice(3, 6)


@dataclass
class TermModel:
    subjects: list[str]
    terms: dict[str, np.ndarray]
    ordinary: frozenset[str] = frozenset()
    top: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.top = {t: int(w.argmax()) for t, w in self.terms.items()}

    def features(self, text: str | None) -> np.ndarray:
        k = len(self.subjects)
        x = np.zeros(k * len(PER_SUBJECT) + len(PAGE))
        if not text:
            return x
        paragraphs, tables = page_units(text)
        terms, top = self.terms, self.top
        units, total, n_words, n_all, n_ordinary = [], np.zeros(k), 0, 0, 0
        for is_table, group in ((False, paragraphs), (True, tables)):
            for u in group:
                w = words(u).split()
                n_words += 0 if is_table else len(w)
                n_all += len(w)
                n_ordinary += sum([t in self.ordinary for t in w])
                hits = [t for t in w if t in top]
                if hits:
                    n = np.bincount([top[t] for t in hits], minlength=k)
                    total += n
                    units.append((is_table, n, np.sum([terms[t] for t in hits], 0)))
        kind = page_kind(text)
        x[k * len(PER_SUBJECT):] = n_words <= STUB_WORDS, n_words > 400, bool(tables) and not len(paragraphs) > 2, kind == "redirect", kind == "talk", n_ordinary < NONSENSE * n_all
        if not total.any():
            return x
        par, tab = np.zeros(k), np.zeros(k)
        # a passing remark has one word of its subject, in a unit that is about something else
        lean, best = np.log((total + 1) / (total.sum() + k)), int(total.argmax())
        for is_table, n, score in units:
            j = int((score + lean).argmax())
            if n[j] >= 2 or (n[j] == 1 and j == best and not is_table):
                (tab if is_table else par)[j] += 1
        leads = np.arange(k) == best
        short = n_words <= STUB_WORDS
        x[: k * len(PER_SUBJECT)] = np.stack([par >= 1, par >= 2, par >= 3, tab >= 1, tab >= 2, np.log1p(total) / 4, total / total.sum(), leads,
                                              short & leads & (total >= 2), short & leads & (total == total.sum())], 1).ravel()
        return x


# --- chain ----------------------------------------------------------------------------------------------------

def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, prior: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Weights (intercept first) by Newton's method with an L2 penalty on the distance from ``prior``."""
    a = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(a.shape[1]) if prior is None else prior.copy(), np.append(1e-3 if prior is None else ridge, np.full(x.shape[1], ridge))
    start = w.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pen * (w - start)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """One calibrated logistic model per subject, each seeing the labels of those before it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sources: np.ndarray):
        n, self.k = y.shape
        self.order = list(np.argsort(-y.sum(0), kind="stable"))
        self.models, self.scale = [], []
        # what all subjects have in common is fitted first; each subject's model starts from it
        pooled = fit_logistic(np.concatenate([self._inputs(x, s, y[:, :0], sources) for s in range(self.k)]), np.concatenate([y[:, s] for s in range(self.k)]))
        hold = np.arange(n) % 5 == 0 if n >= 50 else np.zeros(n, bool)
        for i, s in enumerate(self.order):
            a = self._inputs(x, s, y[:, self.order[:i]], sources)
            w = fit_logistic(a[~hold], y[~hold, s], 3.0, np.append(pooled, np.zeros(i)))
            z = w[0] + a @ w[1:]
            # Platt scaling on the part held out
            self.scale.append(fit_logistic(z[hold][:, None], y[hold, s], 3.0, np.array([0.0, 1.0])) if 0 < y[hold, s].sum() < hold.sum() else np.array([0.0, 1.0]))
            self.models.append(w)

    def _inputs(self, x: np.ndarray, s: int, before: np.ndarray, sources: np.ndarray) -> np.ndarray:
        m = len(PER_SUBJECT)
        own, page = x[:, s * m: (s + 1) * m], x[:, self.k * m:]
        dead = page[:, DEAD].max(1, keepdims=True)
        return np.column_stack([own, page, own * dead, own[:, 7:8] * page[:, :3], sources, before])

    def decode(self, x: np.ndarray, sources: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Most likely label combination of each row, by beam search along the chain."""
        n = len(x)
        labels, score = np.zeros((n, 1, self.k)), np.zeros((n, 1))
        for i, (s, w, c) in enumerate(zip(self.order, self.models, self.scale)):
            b = labels.shape[1]
            flat = labels.reshape(n * b, self.k)
            a = self._inputs(np.repeat(x, b, 0), s, flat[:, self.order[:i]], np.repeat(sources, b, 0))
            z = np.clip(c[0] + c[1] * (w[0] + a @ w[1:]), -30, 30).reshape(n, b)
            no, yes = score - np.log1p(np.exp(z)), score - np.log1p(np.exp(-z))
            with_s = labels.copy()
            with_s[:, :, s] = 1
            labels, score = np.concatenate([labels, with_s], 1), np.concatenate([no, yes], 1)
            best = np.argsort(-score, 1, kind="stable")[:, :beam]
            labels, score = np.take_along_axis(labels, best[:, :, None], 1), np.take_along_axis(score, best, 1)
        return labels[:, 0].astype(bool)


@dataclass
class SubjectModel:
    terms: TermModel
    chain: Chain
    sources: dict[str, int]

    def source_columns(self, values) -> np.ndarray:
        out = np.zeros((len(values), len(self.sources)))
        for i, v in enumerate(values):
            if v in self.sources:
                out[i, self.sources[v]] = 1
        return out

    def classify(self, texts: list, sources: list) -> np.ndarray:
        """(document, subject) matrix."""
        if not len(texts):
            return np.zeros((0, self.chain.k), bool)
        x = np.stack([self.terms.features(t) for t in texts])
        return self.chain.decode(x, self.source_columns(sources))


def train(texts: list[str], sources: list[str | None], labels: list[set[int]], subjects: list[str], plain: list[tuple[str, str | None]] = ()) -> SubjectModel:
    """``plain``: (text, source) of other documents; those that can't have a subject teach the chain so."""
    terms = TermModel(subjects, *learn_terms(texts, labels, len(subjects)))
    x = [terms.features(t) for t in texts]
    for text, source in plain:
        f = terms.features(text)
        if f[len(subjects) * len(PER_SUBJECT):][DEAD].any():
            x.append(f)
            sources, labels = [*sources, source], [*labels, set()]
    known = {s: i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    y = np.zeros((len(x), len(subjects)))
    for i, own in enumerate(labels):
        y[i, list(own)] = 1
    model = SubjectModel(terms, None, known)
    model.chain = Chain(np.stack(x), y, model.source_columns(sources))
    return model


# --- Spark ----------------------------------------------------------------------------------------------------

def training_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], limit: int = MAX_LABELLED, plain: int = MAX_PLAIN, chars: int = MAX_LABELLED_CHARS) -> list[tuple]:
    """(text, source, label set or None) of at most ``limit`` labelled documents and ``plain`` others, the same for any
    order of the rows; one reading of the texts."""
    known = {s.strip().lower(): i for i, s in enumerate(subjects)}
    name = F.lower(F.trim("subject"))
    own = labels.filter(F.col("doc_id").isNotNull() & name.isin(list(known))).groupBy("doc_id").agg(F.collect_set(name).alias("own"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    other = documents.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(plain).withColumn("own", F.lit(None).cast("array<string>"))
    picked = own.unionByName(other).groupBy("doc_id").agg(F.max("own").alias("own"))
    rows = documents.filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    rows = cut_lineage(rows.groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("d"), F.max("own").alias("own")).select("doc_id", "d.*", "own"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > chars:  # only whole documents are left out of the sample
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) < int(1000 * chars / size))
    return [(r["text"], r["source"], None if r["own"] is None else {known[x] for x in r["own"]}) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def subject_areas(documents: DataFrame, labels: DataFrame, subject_table: DataFrame) -> DataFrame:
    """``doc_id, subject``: the subjects of every document that has one."""
    subjects = sorted(r[0] for r in subject_table.filter("subject IS NOT NULL").select("subject").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    d = documents.filter("doc_id IS NOT NULL").select("doc_id", "text", "source")
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, subject string"
    got = training_sample(d, labels, subjects)
    marked = [x for x in got if x[2] is not None]
    if not marked:
        return documents.sparkSession.createDataFrame([], schema)
    texts, sources, own = ([x[i] for x in marked] for i in range(3))
    plain = [x[:2] for x in got if x[2] is None]
    model = broadcast_model(documents.sparkSession, train(texts, sources, own, subjects, plain))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i: i + 1000]
                doc, sub = np.nonzero(m.classify(part["text"].tolist(), part["source"].tolist()))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "subject": np.array(subjects, object)[sub]})

    return d.mapInPandas(classify, schema)
