import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators.rolling import band, rolling_totals

SCHEMA = "iy int, ix int, time date, prcp float, norm float, value string, has_row string"
DAY = dt.date(2021, 10, 1)


def roll(spark, data, windows=(3, 7), tile=8):
    df = spark.createDataFrame(data, SCHEMA)
    return rolling_totals(df, ["iy", "ix"], "time", F.col("prcp"), windows, {"least": F.min("norm")}, tile=tile)


def row(d, v, iy=0, ix=0, norm=None):
    return (iy, ix, DAY + dt.timedelta(days=int(d)) if d is not None else None, v, norm, "clash", "clash")


def test_band():
    assert band(2, 1, 3).tolist() == [[1, 0, 0], [1, 1, 0], [0, 1, 1], [0, 0, 1]]


def test_against_loop(spark):
    rng = np.random.default_rng(2)
    data = {}
    for e in range(5):
        for d in rng.choice(90, 30, replace=False):
            data[e, int(d)] = float(np.float32(rng.gamma(1, 5))) if rng.random() > 0.2 else None
    got = {(r["ix"], (r["day"] - DAY).days): r for r in roll(spark, [row(d, v, ix=e) for (e, d), v in data.items()]).collect()}
    for e in range(5):
        days = [d for x, d in data if x == e]
        assert sorted(d for x, d in got if x == e) == list(range(min(days), max(days) + 1))
    for (e, d), r in got.items():
        assert r["has_row"] == ((e, d) in data)
        for w in (3, 7):
            v = [data[e, k] for k in range(d - w + 1, d + 1) if data.get((e, k)) is not None]
            assert r[f"n_{w}"] == len(v) and r[f"total_{w}"] == pytest.approx(sum(v), abs=1e-6)
            assert (r[f"mean_{w}"] is None) if not v else r[f"mean_{w}"] == pytest.approx(np.mean(v))


def test_dirt(spark):
    data = [row(0, 1.0, norm=2.0), row(0, 1.0, norm=1.0), row(40, float("nan")), row(None, 9.0), row(1, float("inf")), row(0, 4.0, iy=None)]
    got = {(r["iy"], (r["day"] - DAY).days): r for r in roll(spark, data).collect()}
    assert got[0, 0]["total_3"] == 1.0 and got[0, 0]["least"] == 1.0
    assert got[0, 1]["value"] is None and got[0, 1]["has_row"] and got[0, 2]["n_3"] == 1
    assert not got[0, 20]["has_row"] and got[0, 20]["total_7"] == 0 and got[0, 20]["mean_7"] is None
    assert got[None, 0]["total_3"] == 4.0 and len(got) == 42


def test_long_gap_and_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = roll(spark, [row(d, 1.0, ix=e) for e in range(30) for d in (0, 1, 100)]).groupBy("ix").agg(F.sum("n_3").alias("n"), F.count("*").alias("c")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 30 and all(r["c"] == 101 and r["n"] == 7 for r in got)


def test_empty(spark):
    assert roll(spark, []).count() == 0


def test_wide_keys_with_null(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, DAY, 1.0), (None, DAY, 2.0), (big - 1, DAY, 4.0)], "k bigint, d date, v double")
    got = {r["k"]: r["total_2"] for r in rolling_totals(df, ["k"], "d", F.col("v"), [2]).collect()}
    assert got == {big: 1.0, None: 2.0, big - 1: 4.0}
