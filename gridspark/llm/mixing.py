"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a hashed order, once for every time they may be used. A copy's virtual finish time
is the source's tokens up to and including it, divided by the source's target weight; in the order of finish times
every source advances at its own rate, so any prefix of the order has the target shares as long as no source has run
dry. The mix is the prefix that fills the token budget; sources that run dry early leave their room to the others.

Running totals are taken without ever ordering a source in one task: the hash order is cut into ``BUCKETS`` ranges (a power of two) per
source and copy, the ranges' sums are added up (a table of sources x copies x ``BUCKETS`` rows at most), and only inside a
range are rows ordered. The copies are then sorted by ranges of the order's key, and the end of the prefix is found by
sums: the fluid limit, computed from one row per source, bounds the finish time at which the budget fills to within one
document per source; that band is cut into ranges by their sums, again and again, until the range in which the budget
fills holds at most ``FEW`` copies, however many small documents lie beside a huge one. The mix is the sorted copies
before that one.

Which sources can't reach their target is read from such a mix too: from one whose budget isn't full before the virtual
time is the total size of all documents, short are those that the queue has served to the last copy with less than
their share of that total.

Defined results: sizes are the tokens of the whole text, NULL texts have none; documents of sources without a target
(or with a NULL source) count in the total but are not used; a NULL or negative target share is 0 and a share of 0
takes nothing; a share of NaN takes nothing either and can't be reached; NULL ``max_repeats`` is 1; ties in the order are broken by document id and text size; repeated documents are
documents of their own; with an empty table the mix is empty and the report lists every source; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import copy
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how the byte-level vocabularies split text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1024
MAX_SOURCES = 10_000
#: texts are encoded in pieces of about this many characters, so one call never holds a huge text; cut only where no
#: token of PATTERN can reach across: between another character and white space
PIECE = 1_000_000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
#: longer runs of white space overflow the encoder's regular expression; what it makes of them is known
_RUN = re.compile(f"[{_SPACE}]{{1000,}}")
#: a bucket of copies that is narrow enough to be ordered in one task
FEW = 100_000
#: the key of the fair order: the virtual finish time, then what breaks ties
ORDER = ("finish", "source", "doc_id", "copy", "tokens")


def token_counter(path: str = TOKENIZER, pattern: str = PATTERN) -> Callable[[str], int]:
    """Number of tokens of a text under a public byte-level vocabulary given as ranks; exact for texts of any length."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def stretch(text: str) -> int:
        n, at = 0, 0
        while len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE)
            if cut is None:
                break
            n, at = n + len(codec.encode_ordinary(text[at: cut.end()])), cut.end()
        return n + len(codec.encode_ordinary(text[at:]))

    def count(text: str) -> int:
        if pattern != PATTERN:  # nothing is known about where its tokens end
            return len(codec.encode_ordinary(text))
        n, at = 0, 0
        for m in _RUN.finditer(text) if len(text) >= 1000 else ():
            # all of the run is one piece at the end of the text, else all but its last character
            end = m.end() - (m.end() < len(text))
            n += stretch(text[at: m.start()]) + len(codec._encode_single_piece(text[m.start(): end]))
            at = end
        return n + stretch(text[at:])

    return count


def document_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, tokens`` of every document."""
    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [count(t) if t else 0 for t in pdf["text"]]})
    # ids travel as text: a NULL among 64-bit numbers would turn them into floats
    id_kind, source_kind = (documents.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    d = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    return d.mapInPandas(size, f"doc_id string, source {source_kind}, tokens bigint").withColumn("doc_id", F.col("doc_id").cast(id_kind))



def fluid_finish(sources: list[dict], budget: float) -> float:
    """Virtual time at which the budget fills if documents were infinitely small (infinity if it never does)."""
    now, used = 0.0, 0.0
    for s in sorted((s for s in sources if s["weight"] > 0 and s["cap"] > 0), key=lambda s: s["cap"] / s["weight"]):
        rate = sum(x["weight"] for x in sources if x["weight"] > 0 and x["cap"] / x["weight"] > now)
        end = s["cap"] / s["weight"]
        if rate > 0 and used + rate * (end - now) >= budget:
            return now + (budget - used) / rate
        used, now = used + rate * (end - now), end
    return float("inf")


class Mix:
    """The plan of a mix: ``queue`` (all copies with their finish times), ``chosen`` (the mix) and ``report``."""

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, pattern: str = PATTERN):
        sizes = cut_lineage(document_sizes(documents, tokenizer, pattern))
        own = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("own_docs"), F.max("tokens").alias("longest"))
        wanted = (targets.filter("source IS NOT NULL").groupBy("source")
                  .agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("int").alias("max_repeats")))
        self.targets = wanted.join(own, "source", "left").fillna(0, ["own_tokens", "own_docs", "longest"])
        self.total = int(own.agg(F.sum("own_tokens")).first()[0] or 0)
        self.budget = self.total if budget is None else budget
        rows = self.targets.limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources have a target")
        self.table = [{"source": r["source"], "weight": r["target_share"], "own": r["own_tokens"], "cap": max(r["max_repeats"], 0) * r["own_tokens"], "longest": r["longest"]} for r in rows]
        self.sizes, self.seed = sizes, seed
        self._plan()

    def _plan(self) -> None:
        """The band of virtual times in which the budget fills, and the queue up to its end."""
        self.full_at = fluid_finish(self.table, self.budget)
        # at any virtual time the real order lags the fluid one by less than a document of each source
        self.high = fluid_finish(self.table, self.budget + sum(s["longest"] for s in self._active()))
        self.queue = self._queue(self.sizes, self.seed)

    def _active(self) -> list[dict]:
        return [s for s in self.table if s["weight"] > 0 and s["cap"] > 0]

    def _queue(self, sizes: DataFrame, seed: int) -> DataFrame:
        """``doc_id, source, copy, tokens, finish``; copies that start after the budget is full are not made."""
        t = self.targets.select("source", "target_share", "max_repeats", F.col("own_tokens")).filter("target_share > 0 AND NOT isnan(target_share) AND max_repeats > 0 AND own_tokens > 0")
        needed = F.col("max_repeats") if self.high == float("inf") else F.least(F.col("max_repeats"), F.ceil(F.lit(float(self.high)) * F.col("target_share") / F.col("own_tokens")).cast("int") + 1)
        d = sizes.join(F.broadcast(t.withColumn("copies", needed)), "source")
        d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        d = d.withColumn("h", F.xxhash64("doc_id", "copy", F.lit(seed)))
        bits = BUCKETS.bit_length() - 1
        d = d.withColumn("b", F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0))
        group = ["source", "copy"]
        sums = d.groupBy(*group, "b").agg(F.sum("tokens").alias("s"))
        before = sums.withColumn("before", F.sum("s").over(Window.partitionBy(*group).orderBy("b")) - F.col("s")).drop("s")
        w = Window.partitionBy(*group, "b").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
        d = d.join(before, [*group, "b"]).withColumn("upto", (F.col("copy") - 1) * F.col("own_tokens") + F.col("before") + F.sum("tokens").over(w))
        return d.select("doc_id", "source", "copy", "tokens", (F.col("upto") / F.col("target_share")).alias("finish"))

    def _limit(self, q: DataFrame) -> tuple | None:
        """(finish, source, doc_id, copy, tokens) of the first copy that no longer fits; None if all do.

        The band of finish times in which the budget fills is cut into ``BUCKETS`` ranges, the one in which it fills
        again, until it holds few copies; copies without tokens can't be the one.
        """
        low, high, have = self.full_at, self.high, int(q.filter(F.col("finish") <= self.full_at).agg(F.sum("tokens")).first()[0] or 0)
        band = q.filter((F.col("finish") > low) & (F.col("finish") <= high) & (F.col("tokens") > 0))
        while True:
            inside = band.filter((F.col("finish") > low) & (F.col("finish") <= high))
            ranges = max(BUCKETS, 2)
            step = (high - low) / ranges if high != float("inf") else None
            if step is None:  # the copies run out before the band ends: it ends with the last of them
                top = inside.agg(F.max("finish")).first()[0]
                if top is None:
                    return None
                high = top
                continue
            k = F.least(F.greatest(F.ceil((F.col("finish") - F.lit(low)) / F.lit(step)), F.lit(1)), F.lit(ranges)).cast("int") if step > 0 else F.lit(1)
            sums = sorted((r["k"], r["s"], r["n"]) for r in inside.groupBy(k.alias("k")).agg(F.sum("tokens").alias("s"), F.count("*").alias("n")).collect())
            full = next((i for i, x in enumerate(sums) if have + sum(y[1] for y in sums[: i + 1]) > self.budget), None)
            if full is None:
                return None
            have += sum(y[1] for y in sums[:full])
            inside = inside.filter(k == sums[full][0])
            a, b = inside.agg(F.min("finish"), F.max("finish")).first()
            if sums[full][2] <= FEW or a == b:
                break
            low, high = max(low, float(np.nextafter(a, -np.inf))), b
        w = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        over = inside.withColumn("sum", F.sum("tokens").over(w) + have).filter(F.col("sum") > self.budget)
        return over.select(*ORDER).orderBy("sum").first()

    @property
    def chosen(self) -> DataFrame:
        """The mix, in the order of virtual finish time."""
        return self._chosen.orderBy(*ORDER)

    @cached_property
    def _chosen(self) -> DataFrame:
        q = cut_lineage(self.queue.orderBy(*ORDER))
        if self.full_at == float("inf"):
            return q
        last = self._limit(q)
        if last is None:
            return q.filter(F.col("finish") <= self.high)
        before, same = F.lit(False), F.lit(True)
        for c in ORDER:  # NULL comes first, as it is ordered
            x, v = F.col(c), F.lit(last[c]).cast(q.schema[c].dataType)
            less = F.lit(False) if last[c] is None else F.coalesce(x < v, F.lit(True))
            before, same = before | (same & less), same & x.eqNullSafe(v)
        return q.filter(before)

    @property
    def report(self) -> DataFrame:
        """Per target source: its size, whether it reaches its target, and what the mix has of it."""
        used = self._chosen.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("used_docs"), F.max("copy").alias("used_repeats"))
        r = self.targets.join(used, "source", "left").fillna(0, ["used_tokens", "used_docs", "used_repeats"])
        everything = int(self._chosen.agg(F.sum("tokens")).first()[0] or 0)
        share = F.col("used_tokens") / F.nullif(F.lit(float(everything)), F.lit(0.0))
        return r.select("source", "target_share", "max_repeats", "own_tokens", "own_docs", "used_tokens", "used_docs", "used_repeats", share.alias("actual_share"), self._reached().alias("reached"))

    def _most(self):
        """Tokens of a source's copies, made or not; as wide as a count of repeats times a count of tokens may be."""
        return F.greatest("max_repeats", F.lit(0)).cast("decimal(10,0)") * F.col("own_tokens")

    def _wanted(self):
        """The source's share of the total size of all documents."""
        return F.col("target_share") * F.lit(float(self.total))

    def _reached(self):
        """A source reaches its target if all its copies, made or not, last until the virtual time is the total size of all documents."""
        return self._wanted() <= self._most().cast("double")

    @property
    def reach(self) -> DataFrame:
        """Per target source whether it can reach its target by its size, without making the mix."""
        return self.targets.select("source", "target_share", "max_repeats", "own_docs", self._reached().alias("reached"))

    @cached_property
    def _long_enough(self) -> Mix:
        """This mix, or with a smaller budget one of the same copies that goes on until the virtual time is the total size of all documents.

        By then the sources have sent their share of the total or all they have, and never more, so a budget of those
        tokens holds every copy that finishes until then.
        """
        need = round(sum(min(s["weight"] * self.total, s["cap"]) for s in self._active()))
        if self.budget >= need:
            return self
        other = copy.copy(self)
        other.__dict__.pop("_chosen", None)
        other.budget = need
        other._plan()
        return other

    @property
    def short(self) -> DataFrame:
        """``source``: those that run dry before the virtual time reaches the total size of all documents, whatever the budget.

        Read from the mix: all their copies are before its end, with less than their share of the total.
        """
        used = self._long_enough._chosen.groupBy("source").agg(F.sum("tokens").alias("used_tokens"))
        r = self.targets.join(used, "source", "left").fillna(0, ["used_tokens"])
        dry = (F.col("used_tokens") >= self._most()) | F.isnan("target_share")
        return r.filter(dry & (F.col("used_tokens") < self._wanted())).select("source")
