import datetime as dt

import numpy as np
import pytest

from gridspark.operators.impute import FIELDS, Category, Numeric, category_counts, category_fit, class_scores, fill_missing, fit_multinomial, independent, numeric_fit

SCHEMA = "time date, iy int, ix int, tmax float, prcp float, temp_flag smallint, prcp_flag smallint, tmax_filled string, field string"
DAY = dt.date(2021, 10, 1)


def row(iy, ix, d, tmax=20.0, prcp=0.0, tf=1, pf=1):
    return (DAY + dt.timedelta(days=int(d)) if d is not None else None, iy, ix, tmax, prcp, tf, pf, "clash", "clash")


def valid(f, v):
    if v is None:
        return False
    return np.isfinite(v) and f.low <= v <= f.high if isinstance(f, Numeric) else v in f.classes


def test_cases_like_a_loop(spark):
    rng = np.random.default_rng(4)
    data = {}
    for _ in range(700):
        k = tuple(int(v) for v in (rng.integers(30), rng.integers(30), rng.integers(40)))
        bad = rng.random(4) < 0.4
        data[k] = (float("nan") if bad[0] else 15.0 + k[0] / 10, None if bad[1] else 1.0, -1 if bad[2] else 1, None if bad[3] else int(rng.integers(2)))
    got = fill_missing(spark.createDataFrame([row(*k, *v) for k, v in data.items()], SCHEMA)).collect()
    assert len(got) == len(data)
    pos = {"tmax": 0, "prcp": 1, "temp_flag": 2, "prcp_flag": 3}
    for r in got:
        k = (r["iy"], r["ix"], (r["time"] - DAY).days)
        for f in FIELDS:
            i = pos[f.name]
            own = valid(f, data[k][i])
            near = any(valid(f, v[i]) for q, v in data.items() if (q[2] == k[2] and abs(q[0] - k[0]) <= 2 and abs(q[1] - k[1]) <= 2) or (q[:2] == k[:2] and abs(q[2] - k[2]) <= 3))
            assert r[f"{f.name}_filled"] == (not own and near)
            assert (r[f.name] is not None) == (own or near)
            if own:
                assert r[f.name] == pytest.approx(data[k][i])
            elif near:
                assert valid(f, r[f.name])


def test_prediction_beats_the_mean():
    rng = np.random.default_rng(0)
    y = 20 + rng.normal(0, 3, (12, 12, 1)) + rng.normal(0, 3, (1, 1, 20)) + rng.normal(0, 0.5, (12, 12, 20))
    v = y.copy()
    gone = rng.random(y.shape) < 0.2
    v[gone] = np.nan
    fit, n = numeric_fit(v, 20.0, 0.5**2 / 9, 0.5**2 / 9)
    assert (n[gone] > 0).all()
    assert np.abs(fit - y)[gone].mean() < 0.45 * np.abs(20 - y)[gone].mean()
    c, _ = category_fit(np.where(gone, np.nan, (y > 20).astype(float)), (0, 1), independent([0.5, 0.5]))
    assert (c == (y > 20))[gone].mean() > 0.7


def seen_rows(v, classes, known):
    """(own class, counts around each, itself left out) of the known values."""
    day, cell = category_counts(v, classes)
    own = np.searchsorted(classes, v[known])
    day, cell = day[:, known].copy(), cell[:, known].copy()
    for c in (day, cell):
        c[own, np.arange(len(own))] -= 1
    return own, day, cell


@pytest.mark.parametrize("classes", [(0, 1), (0, 1, 2)])
def test_multinomial_model_beats_independent_shares(classes):
    """Day and cell are no independent witnesses here; held-out values are more likely under the fitted model."""
    rng = np.random.default_rng(2)
    weather = rng.normal(0, 1, (1, 1, 60)) + rng.normal(0, 0.3, (14, 14, 1)) + rng.normal(0, 1.2, (14, 14, 60))
    y = np.digitize(weather, [0.4, 1.2][: len(classes) - 1]).astype(float)
    v, gone = y.copy(), rng.random(y.shape) < 0.2
    v[gone] = np.nan
    share = [float((v == k).sum() / (~gone).sum()) for k in classes]
    own, day, cell = seen_rows(v, classes, ~gone)
    model = fit_multinomial(own, day, cell, np.ones(len(own)), share)

    def held_out(m):
        z = class_scores(*category_counts(v, classes), m)[:, gone]
        q = np.exp(z - z.max(0)) / np.exp(z - z.max(0)).sum(0)
        return np.log(q[y[gone].astype(int), np.arange(gone.sum())]).mean(), (np.argmax(z, 0) == y[gone]).mean()

    (like, right), (plain, plain_right) = held_out(model), held_out(independent(share))
    assert like > plain + 0.01 and right >= plain_right - 0.005
    # the same from aggregates
    rows, n = np.unique(np.vstack([own, day, cell]), axis=1, return_counts=True)
    k = len(classes)
    again = fit_multinomial(rows[0].astype(int), rows[1: k + 1], rows[k + 1:], n.astype(float), share)
    assert np.allclose(again["intercept"] + again["weight"], model["intercept"] + model["weight"], atol=1e-6)


def test_multinomial_fit_is_a_maximum():
    rng = np.random.default_rng(3)
    own, day, cell = rng.integers(0, 2, 300), rng.integers(0, 9, (2, 300)).astype(float), rng.integers(0, 4, (2, 300)).astype(float)
    share = [0.6, 0.4]
    m = fit_multinomial(own, day, cell, np.ones(300), share)
    start = independent(share)

    def loss(t):
        z = class_scores(day, cell, {"share": share, "intercept": t[:2], "weight": t[2:]})
        return (np.log(np.exp(z).sum(0)) - z[own, np.arange(300)]).sum() + 0.5 * ((t - np.array(start["intercept"] + start["weight"])) ** 2).sum()

    best = np.array(m["intercept"] + m["weight"])
    for i in range(4):
        for step in (-1e-3, 1e-3):
            t = best.copy()
            t[i] += step
            assert loss(t) > loss(best)


def test_shrinks_to_the_mean_without_support():
    v = np.full((5, 5, 7), np.nan)
    v[0, 0, 0] = 30.0
    fit, n = numeric_fit(v, 20.0, 1.0, 1.0)
    assert n[4, 4, 6] == 0 and 20 < fit[0, 1, 0] < 30 and fit[0, 1, 0] == pytest.approx(25.0)


def test_dirt(spark):
    data = [row(0, 0, 0), row(0, 0, 0), row(0, 1, 0, float("inf"), -1.0, 255, None), row(None, 0, 0, None), row(0, 0, None, None), row(50, 50, 0, 99.0)]
    got = fill_missing(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 5
    r = {(x["iy"], x["ix"], x["time"]): x for x in got}
    x = r[0, 1, DAY]
    assert x["tmax_filled"] and x["prcp_filled"] and x["temp_flag_filled"] and x["prcp_flag_filled"] and x["temp_flag"] == 1 and x["tmax"] == pytest.approx(20.0)
    assert r[None, 0, DAY]["tmax"] is None and not r[None, 0, DAY]["tmax_filled"] and not r[50, 50, DAY]["tmax_filled"]


def test_empty(spark):
    assert fill_missing(spark.createDataFrame([], SCHEMA)).count() == 0
    assert Category("x", (0,)).name == "x"
