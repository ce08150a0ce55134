"""Evaluation texts leaking into training text.

One Aho-Corasick automaton holds the normalised evaluation texts, cut into consecutive blocks of ``BLOCK`` words.
Any ``MIN_WORDS`` consecutive words of a text contain a whole block, so one scan of each document's visible,
normalised text meets every leak; each hit is extended word by word on both sides and counts from ``MIN_WORDS``
words on. Documents are scanned where they lie: nothing of the corpus is shuffled. The positions of a hit are
mapped back to the original markup.

The evaluation side is split into automata of at most ``AUTOMATON_CHARS`` characters (a fixed bound on what is on the
driver at once and on what is sent to the executors), one scan for each; the usual sets fit into one. An automaton is
built once, on the driver, and travels as bytes; a Python worker unpacks it once and keeps it for its later tasks.

Defined results: case, punctuation, spacing, markup and invisible characters don't matter; evaluation texts under
``MIN_WORDS`` words can't leak; NULL texts and ids give no row; repeated documents and items give each pair once per
row of documents; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.shared import broadcast_model
from gridspark.llm.wikitext import render, words

MIN_WORDS = 15
BLOCK = (MIN_WORDS + 1) // 2
AUTOMATON_CHARS = 4_000_000


class LeakFinder:
    """The automaton of a set of (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        import ahocorasick

        self.min_words, self.block = min_words, (min_words + 1) // 2
        self.items = [(i, words(render(t)).split()) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w) >= min_words]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, w) in enumerate(self.items):
            for k in range(0, len(w) - self.block + 1, self.block):
                places.setdefault(f" {' '.join(w[k: k + self.block])} ", []).append((n, k))
        self.automaton = ahocorasick.Automaton()
        for block, at in places.items():
            self.automaton.add_word(block, (len(block), at))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def _extend(self, text: str, start: int, end: int, w: list[str], k: int, most: int) -> tuple[int, int, int]:
        """(words matched, start, end): the run around block k..k+block found at text[start:end] (spaces included)."""
        n, a = self.block, k - 1
        while a >= 0 and k - 1 - a < most:
            at = text.rfind(" ", 0, start)
            if at < 0 or text[at + 1: start] != w[a]:
                break
            start, a, n = at, a - 1, n + 1
        b = k + self.block
        while b < len(w) and b - k - self.block < most:
            at = text.find(" ", end)
            if at < 0 or text[end: at] != w[b]:
                break
            end, b, n = at + 1, b + 1, n + 1
        return n, start, end

    def find(self, text: str | None) -> set[int]:
        """Numbers of the items that leak into the document."""
        if self.empty or not text:
            return set()
        flat, found = words(render(text)), set()
        for last, (size, places) in self.automaton.iter(flat):
            for n, k in places:
                if n not in found and self._extend(flat, last + 1 - size, last + 1, self.items[n][1], k, self.min_words)[0] >= self.min_words:
                    found.add(n)
        return found

    def longest(self, text: str, wanted: set[int]) -> list[tuple[int, int, int, int]]:
        """(item number, words, start, end in the original) of each wanted item's longest run."""
        flat, pos = words(*render(text, track=True))
        best: dict[int, tuple[int, int, int]] = {}
        for last, (size, places) in self.automaton.iter(flat):
            for n, k in places:
                if n in wanted and not (n in best and best[n][1] <= last + 1 - size and last + 1 <= best[n][2]):
                    run = self._extend(flat, last + 1 - size, last + 1, self.items[n][1], k, len(self.items[n][1]))
                    if n not in best or run[0] > best[n][0]:
                        best[n] = run
        return [(n, c, int(pos[a + 1]), int(pos[max(a + 1, b - 2)]) + 1) for n, (c, a, b) in best.items()]


def _groups(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    """(item, text) rows, about ``AUTOMATON_CHARS`` characters at a time; a group is let go before the next one is read."""
    rows = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // AUTOMATON_CHARS) or 1
    for k in range(n):
        yield [(r["i"], r["t"]) for r in (rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows).collect()]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", where: bool = False) -> DataFrame:
    """``doc_id, item_id`` of every leak; with ``where`` also ``n_words, start, end`` of the longest passage."""
    d = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}" + (", n_words int, start int, `end` int" if where else "")
    parts = []
    for group in _groups(items, item_id, item_text):
        ready = broadcast_model(documents.sparkSession, LeakFinder(group))

        def scan(batches: Iterator[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
            finder = ready()
            for pdf in batches:
                rows = []
                for i, t in zip(pdf["doc_id"], pdf["text"]):
                    found = finder.find(t)
                    if found and where:
                        best: dict = {}  # an item may be listed more than once
                        for n, c, a, b in sorted(finder.longest(t, found)):
                            if c > best.get(finder.items[n][0], (0,))[0]:
                                best[finder.items[n][0]] = (c, a, b)
                        rows += [(i, item, *run) for item, run in best.items()]
                    else:
                        rows += [(i, item) for item in {finder.items[n][0] for n in found}]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", *(["n_words", "start", "end"] if where else [])])

        parts.append(d.mapInPandas(scan, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
