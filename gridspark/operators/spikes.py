"""Implausible readings per source: spikes, stuck values and physical impossibilities.

Each series (station and element) is folded into a matrix of daily profiles, a row for every few days, a column for
each day of the profile. Robust principal components split it into a low-rank part, what this source normally reports
around that time of year, a sparse part, the spikes, and noise. The low-rank part is the series' level plus one
component (a score per profile times a weight per day of it), fitted by alternating least squares in which

* a profile's score is shrunk towards its neighbours' and theirs towards zero, by ratios of noise to signal variance
  taken from the matrix itself, so a component that the readings don't support vanishes;
* readings far from the fit get little weight at first and none in the end: they are the sparse part.

The matrix is folded twice, half a profile apart, and the two low-rank parts are averaged, so no day is always at a
profile's edge. Nothing is smoothed beforehand. Constant runs and physical ranges are tested on their own.

``level`` elements (temperatures) enter as they are; a reading's score is its distance from the low-rank part in robust
standard deviations. ``amount`` elements (precipitation: many zeros, long tail) enter as logarithms of the wet days, and
the score is the ratio of a reading to the upper decile that the source has around that time of year.

Repeated (series, date) rows are merged by a partial aggregate first, so a series holds at most one row per
calendar day and no group grows beyond the length of the calendar; series are spread by (station, element).

Defined results: values that are no finite number are no readings and never flagged; values outside the physical
range (missing codes written as numbers) are ``impossible`` and left out of the other tests; a date that is no real
day only gets the range test; NULL station or element is a series of its own; elements without a listed range have
none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import finite
from gridspark.operators.grouped import whole_groups

#: both lie inside the gap between the scores of normal readings and of spikes in the local tables; README says how they came about
SPIKE_LEVEL, SPIKE_AMOUNT = 6.2, 5.5
RUN = 7
ROUNDS = 8
#: how far, in profiles, a profile's score looks for its neighbours', and their weights
REACH = 60
_AWAY = np.arange(-REACH, REACH + 1)


@dataclass(frozen=True)
class Element:
    low: float
    high: float
    kind: str = "level"


#: tenths of a degree, tenths of a millimetre
ELEMENTS = {"TMAX": Element(-900, 600), "TMIN": Element(-900, 600), "TOBS": Element(-900, 600), "PRCP": Element(0, 20000, "amount")}


@dataclass(frozen=True)
class Profile:
    """How a kind of element is folded and fitted."""

    days: int
    near: float  # standard deviation, in profiles, of the weights of the neighbours' scores
    own: bool  # whether a profile may differ from its neighbours
    even: float  # how many readings' worth a day of the profile is held to the same weight as the others
    floor: float  # least standard deviation of the noise


#: the wet days of two weeks are too few to tell one profile from the next, so amounts only follow the season
PROFILES = {"level": Profile(15, 2.0, True, 4.0, 5.0), "amount": Profile(30, 1.0, False, 40.0, 0.3)}


def _at(a: np.ndarray, q: float) -> float:
    """The reading at quantile ``q`` (the lower one of two)."""
    k = int(q * (len(a) - 1))
    return float(np.partition(a, k)[k])


def upper_decile(rest: np.ndarray) -> tuple[float, np.ndarray]:
    """(upper decile of log residuals without their outliers, which ones were kept)."""
    keep, q = rest <= _at(rest, 0.5) + np.log(20), 0.0
    for _ in range(20):
        q = _at(rest[keep], 0.9)
        still = keep & (rest <= q + np.log(4))
        if still.sum() == keep.sum():
            break
        keep = still
    return q, keep


def _weights(rest: np.ndarray, kind: str, floor: float, settle: bool) -> np.ndarray:
    """Weight of each reading in the next round; 0 for the sparse part."""
    if kind == "amount":
        return upper_decile(rest)[1].astype(float)
    far = np.abs(rest)
    unit = max(1.4826 * _at(far, 0.5), floor)
    return (far <= 4.5 * unit).astype(float) if settle else np.minimum(1.0, 1.5 * unit / np.maximum(far, 1e-9))


def low_rank_part(row: np.ndarray, col: np.ndarray, y: np.ndarray, kind: str, rounds: int = ROUNDS) -> np.ndarray:
    """Low-rank part at the given entries (profile ``row``, day ``col``, value ``y``) of a profile matrix."""
    p, n_rows = PROFILES[kind], int(row.max()) + 1
    kernel = np.exp(-0.5 * (_AWAY / p.near) ** 2) + 1e-3 * np.exp(-np.abs(_AWAY) / 20.0)
    if p.own:
        kernel[REACH] = 0.0  # its own readings count apart
    around = lambda a: np.convolve(a, kernel)[REACH: REACH + n_rows]
    score, day, level = np.zeros(n_rows), np.ones(p.days), _at(y, 0.5)
    low = np.full(len(y), level)
    for k in range(rounds):
        w = _weights(y - low, kind, p.floor, k >= rounds // 2)
        total = max(w.sum(), 1e-9)
        level = (w * (y - score[row] * day[col])).sum() / total
        z = y - level
        n, s = np.bincount(row, w * day[col] ** 2, n_rows), np.bincount(row, w * z * day[col], n_rows)
        mean, used = s / np.maximum(n, 1e-9), max(int((n > 0).sum()), 1)
        noise = max((w * (z - mean[row] * day[col]) ** 2).sum() / max(total - used, 1.0), (p.floor / 2) ** 2)
        # what neighbouring profiles share is signal; what profiles differ by beyond noise and that is their own
        both = np.sqrt(n[1:] * n[:-1])
        shared = max((both * mean[1:] * mean[:-1]).sum() / both.sum(), 0.0) if both.sum() > 0 and used > 3 else 0.0
        own = max((n * mean ** 2).sum() / total - noise * used / total - shared, 1e-3 * noise)
        pull = noise / max(shared, 1e-6 * noise)
        score = around(s) / (around(n) + (pull * 1e-3 if p.own else pull) + 1e-12)
        if p.own:
            score = (s + noise / own * score) / (n + noise / own)
        few = p.even * (w * score[row] ** 2).sum() / total
        day = (np.bincount(col, w * score[row] * z, p.days) + few) / (np.bincount(col, w * score[row] ** 2, p.days) + few + 1e-12) if few > 0 else day
        low = level + score[row] * day[col]
    return low


def normal_behaviour(day: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """What the series normally reports on the days of its readings, from two foldings half a profile apart."""
    size, first = PROFILES[kind].days, day - day.min()
    return np.mean([low_rank_part((first + o) // size, (first + o) % size, y, kind) for o in (0, (size + 1) // 2)], 0)


def spike_scores(day: np.ndarray, v: np.ndarray, kind: str) -> np.ndarray:
    """Distance of each reading from the series' normal behaviour, in its own units."""
    score = np.zeros(len(v))
    if kind == "level":
        if len(v):
            rest = v - normal_behaviour(day, v, kind)
            score = np.abs(rest) / max(1.4826 * _at(np.abs(rest), 0.5), PROFILES[kind].floor)
        return score
    wet = v > 0
    if wet.any():
        y = np.log(v[wet])
        rest = y - normal_behaviour(day[wet], y, kind)
        score[wet] = np.exp(rest - upper_decile(rest)[0])
    return score


def stuck(v: np.ndarray, run: int = RUN) -> np.ndarray:
    """Readings, in order of date, in a run of at least ``run`` equal values other than zero."""
    if not len(v):
        return np.zeros(0, bool)
    new = np.append(True, v[1:] != v[:-1])
    length = np.diff(np.append(np.nonzero(new)[0], len(v)))
    return np.repeat(length >= run, length) & (v != 0)


def implausible(df: DataFrame, station: str = "station_id", date: str = "date", element: str = "element", value: str = "value", elements: dict[str, Element] | None = None) -> DataFrame:
    """One row per flagged reading: ``station_id, date, element, value DOUBLE, spike, stuck, impossible BOOLEAN, score``."""
    elements = ELEMENTS if elements is None else elements
    number = F.trim(F.col(value).cast("string")).try_cast("double")
    d = df.select(F.col(station).alias("station_id"), F.col(date).alias("date"), F.col(element).alias("element"), number.alias("value")).filter(finite(F.col("value")))
    d = d.groupBy("station_id", "element", "date").agg(F.max("value").alias("value"))
    wrong = F.lit(False)
    for name, e in elements.items():
        wrong = wrong | ((F.col("element") == name) & ~F.col("value").between(e.low, e.high))
    d = d.withColumn("impossible", F.coalesce(wrong, F.lit(False)))
    day = F.try_to_timestamp(F.col("date"), F.lit("yyyyMMdd")).cast("date")
    d = d.withColumn("__d", F.datediff(day, F.lit("1970-01-01").cast("date")))
    d = d.repartition("station_id", "element").sortWithinPartitions("station_id", "element", "__d")
    kinds = {k: e.kind for k, e in elements.items()}

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for pdf, start in whole_groups(batches, ["station_id", "element"]):
            day, v, names = pdf["__d"].to_numpy(float), pdf["value"].to_numpy(float), pdf["element"].to_numpy()
            outside = pdf["impossible"].to_numpy(bool)
            usable = ~outside & ~np.isnan(day)
            score, held, spike = np.full(len(pdf), np.nan), np.zeros(len(pdf), bool), np.zeros(len(pdf), bool)
            for a, b in zip(start, np.append(start[1:], len(pdf))):
                kind, use = kinds.get(names[a], "level"), a + np.nonzero(usable[a:b])[0]
                score[use] = spike_scores(day[use].astype(np.int64), v[use], kind)
                spike[use] = score[use] > (SPIKE_LEVEL if kind == "level" else SPIKE_AMOUNT)
                held[use] = stuck(v[use])
            hit = spike | held | outside
            out = pdf.loc[hit, ["station_id", "date", "element", "value"]]
            yield out.assign(spike=spike[hit], stuck=held[hit], impossible=outside[hit], score=score[hit])

    schema = ", ".join(f"{c} {df.schema[n].dataType.simpleString()}" for c, n in (("station_id", station), ("date", date), ("element", element)))
    found = d.mapInPandas(test, schema + ", value double, spike boolean, stuck boolean, impossible boolean, score double")
    return found.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
