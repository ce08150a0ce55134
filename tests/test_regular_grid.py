import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridspark.operators import regular_grid as rg
from gridspark.operators.regular_grid import HALF_WIDTH_DAYS, HOT_SHARE, MIN_SUPPORT, REACH, regular_grid

#: every source by moments, some, or none
SHARES = [0.0, 0.3, 2.0]

SCHEMA = "time timestamp_ntz, iy int, ix int, LAI_norm float, LAI_flag tinyint, period string, value string"


def grid(spark, data, **options):
    return regular_grid(spark.createDataFrame(data, SCHEMA), ["iy", "ix"], "time", "LAI_norm", "LAI_flag", **options)


def reading(day, y, flag=1, iy=0, ix=0, hour=12):
    return (dt.datetime(2020, 1, 1, hour) + dt.timedelta(days=day), iy, ix, y, flag, "x", "clash")


def period(t):
    return t.year * 92 + (t.timetuple().tm_yday - 1) // 4


def brute(points):
    """points: (datetime, y) valid ones and all times; fit by least squares per period."""
    valid = {t: y for t, y, ok in points if ok}
    every = [period(t) for t, _, _ in points]
    out = {}
    for p in range(min(every), max(every) + 1):
        start = dt.datetime(p // 92, 1, 1) + dt.timedelta(days=4 * (p % 92))
        end = min(start + dt.timedelta(days=4), dt.datetime(start.year + 1, 1, 1))
        mid = start + (end - start) / 2
        near = [(t, y) for t, y in valid.items() if abs(period(t) - p) <= REACH]
        x = np.array([(t - mid).total_seconds() / 86400 / HALF_WIDTH_DAYS for t, _ in near])
        y = np.array([v for _, v in near])
        w = np.maximum(1 - x * x, 0) if len(near) else np.zeros(0)
        n = sum(period(t) == p for t in valid)
        support = w.sum() ** 2 / (w * w).sum() if len(near) and w.sum() > 0 else 0.0
        mark = "observed" if n else "filled" if support >= MIN_SUPPORT else "missing"
        fit = None
        if mark != "missing":
            det = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
            if det > w.sum() ** 2 * 1e-3:
                a = np.stack([np.ones(len(x)), x], 1)
                fit = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))[0]
            else:
                fit = (w * y).sum() / w.sum()
        out[p] = (n, support, mark, fit)
    return out


@pytest.mark.parametrize("hot_share", SHARES)
def test_against_least_squares(spark, hot_share):
    rng = np.random.default_rng(5)
    data = [reading(float(d), float(np.float32(np.sin(d / 40) + rng.normal(0, 0.1))), int(rng.choice([1, 1, 1, 0, 2])), ix=int(rng.integers(3)))
            for d in np.cumsum(rng.exponential(7, 150))]
    got = {(r["ix"], r["period"]): r for r in grid(spark, data, hot_share=hot_share).collect()}
    for ix in range(3):
        want = brute([(t, y, f == 1) for t, _, i, y, f, *_ in data if i == ix])
        assert {p for i, p in got if i == ix} == set(want)
        for p, (n, support, mark, fit) in want.items():
            r = got[ix, p]
            assert (r["n_readings"], r["mark"]) == (n, mark)
            assert r["support"] == pytest.approx(support, abs=1e-6)
            assert (r["value"] is None) == (fit is None)
            assert fit is None or r["value"] == pytest.approx(fit, abs=1e-5)


def test_year_end_and_leap(spark):
    starts = {str(r["period_start"]) for r in grid(spark, [reading(0, 1.0), reading(367, 1.0)]).collect()}
    assert {"2020-12-26", "2020-12-30", "2021-01-01"} <= starts and len(starts) == 93


@pytest.mark.parametrize("hot_share", SHARES)
def test_dirt(spark, hot_share):
    data = [reading(0, 1.0), reading(0, 1.0), reading(1, float("nan")), reading(2, None), reading(30, 2.0, None), reading(3, 5.0, 2), (None, 0, 0, 1.0, 1, "x", "c"), reading(1, 3.0, iy=None)]
    r = {(x["iy"], x["period"] - 2020 * 92): x for x in grid(spark, data, hot_share=hot_share).collect()}
    assert r[0, 0]["n_readings"] == 1 and r[0, 0]["value"] == pytest.approx(1.0)
    assert r[0, 7]["mark"] == "missing" and r[0, 7]["value"] is None and r[0, 7]["support"] == 0
    assert r[None, 0]["mark"] == "observed" and len(r) == 9


def test_empty(spark):
    g = grid(spark, [])
    assert g.count() == 0 and g.columns == ["iy", "ix", "period", "period_start", "value", "n_readings", "support", "mark"]


def by_days(data, half_width):
    """(support, value) of each period from all readings within ``half_width`` days of its midpoint."""
    times = [t for t, *_ in data]
    out = {}
    for p in range(min(map(period, times)), max(map(period, times)) + 1):
        start = dt.datetime(p // 92, 1, 1) + dt.timedelta(days=4 * (p % 92))
        mid = start + (min(start + dt.timedelta(days=4), dt.datetime(start.year + 1, 1, 1)) - start) / 2
        x = np.array([(t - mid).total_seconds() / 86400 / half_width for t in times])
        x, y = x[abs(x) < 1], np.array([r[3] for r in data])[abs(x) < 1]
        w = 1 - x * x
        det = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
        a = np.stack([np.ones(len(x)), x], 1)
        out[p] = (w.sum() ** 2 / (w * w).sum() if len(x) else 0.0, np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))[0] if det > w.sum() ** 2 * 1e-3 else None)
    return out


@pytest.mark.parametrize("hot_share", [0.0, 2.0])
@pytest.mark.parametrize("half_width", [14.0, 28.0, 5.0, 40.0, 500.0])
def test_every_reading_in_the_kernel(spark, half_width, hot_share):
    rng = np.random.default_rng(8)
    data = [reading(float(d), float(np.float32(rng.normal())), hour=0) for d in np.cumsum(rng.uniform(0.5, 6, 260))]
    g = regular_grid(spark.createDataFrame(data, SCHEMA), ["iy", "ix"], "time", "LAI_norm", "LAI_flag", half_width=half_width, hot_share=hot_share)
    got = {r["period"]: r for r in g.collect()}
    want = by_days(data, half_width)
    assert set(got) == set(want)
    for p, (support, value) in want.items():
        assert got[p]["support"] == pytest.approx(support, abs=1e-6), p
        if value is not None and got[p]["value"] is not None:
            assert got[p]["value"] == pytest.approx(value, abs=1e-5), p


@pytest.mark.parametrize("hot_share", SHARES)
def test_new_year_gap_is_filled(spark, hot_share):
    """Readings 11 and 12 days before the middle of Jan 1-4 lie four periods back."""
    g = grid(spark, [reading(d, 1.0) for d in (355, 356, 390)], hot_share=hot_share)
    r = {str(x["period_start"]): x for x in g.collect()}["2021-01-01"]
    assert r["mark"] == "filled" and r["value"] == pytest.approx(1.0)


def test_readings_at_the_kernels_very_edge(spark):
    """A reading on the edge has no weight, one within a second of it the support of one reading; on both ways."""
    data = [(dt.datetime(2020, 1, 1), 0, 0, 1.0, 1, "x", "c"), (dt.datetime(2020, 1, 15, 0, 0, 0, 1), 0, 0, 2.0, 1, "x", "c"), (dt.datetime(2020, 3, 1), 0, 0, 1.0, 1, "x", "c")]
    a, b = ({r["period"]: r for r in grid(spark, data, hot_share=s).collect()} for s in (0.0, 2.0))
    assert set(a) == set(b)
    for p in a:
        assert a[p]["support"] == pytest.approx(b[p]["support"], abs=1e-6) and a[p]["mark"] == b[p]["mark"], p


def test_no_key_is_hot(spark):
    """One pixel with a tenth of all rows: the keys of the shuffles hold under a thousandth of them each."""
    n = 60_000
    d = spark.range(n).withColumn("ix", F.when(F.col("id") % 10 == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(300))).cast("int"))
    d = d.select("ix", F.expr("timestamp_seconds(1577836800 + (pmod(xxhash64(id, 5), 94608000)))").alias("time"), F.lit(1.0).alias("v"))
    rows = d.select("ix", F.col("time").alias("__time"), F.col("v").alias("__y")).withColumn("__q", rg.period_of(F.col("__time"))).withColumn("__t", rg.days_since_epoch(F.col("__time")))
    hot = rg.hot_sources(rows, ["ix"], HOT_SHARE)
    assert [r[0] for r in hot.collect()] == [-1]
    first, last = rg.reached(F.col("__t"), HALF_WIDTH_DAYS)
    blocks = rows.filter("ix <> -1").withColumn("b", F.explode(F.sequence(rg._block(first), rg._block(last)))).groupBy("ix", "b").count()
    assert blocks.agg(F.max("count")).first()[0] < n / 1000
    # a hot source's readings are spread by their times, and meet as one row per cell and task
    assert rows.filter("ix = -1").groupBy("ix", "__q", "__t").count().agg(F.max("count")).first()[0] < 5
    g = regular_grid(d, ["ix"], "time", "v")
    assert g.filter("ix = -1").agg(F.sum("n_readings")).first()[0] == rows.filter("ix = -1").select("__t").distinct().count()
