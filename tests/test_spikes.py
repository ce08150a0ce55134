import datetime as dt

import numpy as np

from gridspark.operators import spikes
from gridspark.operators.spikes import SPIKE_AMOUNT, SPIKE_LEVEL, implausible, low_rank_part, spike_scores, stuck

SCHEMA = "station_id string, date string, element string, value string, loaded_at string, score string, spike string"


def series(rng, n=400):
    day = np.sort(rng.choice(n, int(n * 0.8), replace=False))
    spell = np.where((day > 100) & (day < 108), -90, 0)
    return day, 150 + 100 * np.sin(day / 58) + spell + rng.normal(0, 20, len(day))


def test_spikes_not_spells():
    rng = np.random.default_rng(1)
    day, v = series(rng)
    at = [20, 150, 151, 250]
    bad = v.copy()
    bad[at] += [300, -280, -280, 260]
    s = spike_scores(day, bad, "level")
    assert set(np.nonzero(s > SPIKE_LEVEL)[0]) == set(at)
    assert (spike_scores(day, v, "level") < SPIKE_LEVEL).all()


def test_low_rank_part_is_learnt():
    rng = np.random.default_rng(2)
    x = 500 + np.outer(rng.normal(0, 100, 30), np.linspace(0.5, 1.5, 15))
    y = x + rng.normal(0, 5, x.shape)
    y[3, 4] += 500
    row, col = (i.ravel() for i in np.indices(x.shape))
    low = low_rank_part(row, col, y.ravel(), "level").reshape(x.shape)
    assert abs(low[3, 4] - x[3, 4]) < 20 and np.abs(low - x).mean() < 5


def without_low_rank(monkeypatch):
    monkeypatch.setattr(spikes, "low_rank_part", lambda row, col, y, kind: np.full(len(y), np.median(y)))


def precision_recall(found, true):
    return len(found & true) / max(len(found), 1), len(found & true) / len(true)


def seasonal(rng, kind, n=900):
    """A strongly seasonal series with spikes in every season: (day, value, true spikes)."""
    day = np.arange(n)
    season = np.sin(2 * np.pi * day / 365)
    at = set(range(30, n - 30, 60))
    if kind == "level":
        v = 100 + 130 * season + rng.normal(0, 20, n)
        for i in at:
            v[i] += 220 if i % 120 else -220
        return day, v, at
    v = np.where(rng.random(n) < 0.4, rng.exponential(60, n) * np.exp(1.6 * season) + 1, 0.0).round()
    for i in at:
        v[i] = 60 * 25 * np.exp(1.6 * season[i])
    return day, v, at


def test_disabling_the_low_rank_part_costs_recall(monkeypatch):
    """Held-out cases: without the decomposition the seasons hide spikes, for levels and for amounts."""
    rng = np.random.default_rng(11)
    for kind, limit in (("level", SPIKE_LEVEL), ("amount", SPIKE_AMOUNT)):
        cases = [seasonal(rng, kind) for _ in range(5)]
        marked = lambda: [set(np.nonzero(spike_scores(d, v, kind) > limit)[0]) for d, v, _ in cases]  # noqa: B023, E731
        full = marked()
        with monkeypatch.context() as m:
            without_low_rank(m)
            bare = marked()
        assert full != bare
        p, r = np.mean([precision_recall(a, true) for (_, _, true), a in zip(cases, full)], 0)
        assert p >= 0.9 and r >= 0.9
        assert np.mean([precision_recall(b, true)[1] for (_, _, true), b in zip(cases, bare)]) <= r - 0.3


def test_disabling_the_low_rank_part_changes_real_rows(spark, monkeypatch):
    import duckdb

    d = duckdb.sql("""select station_id s, element e, date_diff('day', DATE '2020-01-01', try_strptime(date, '%Y%m%d')::DATE) d, max(try_cast(trim(value) AS DOUBLE)) v
                      from '/root/testdata/sf0.01/obs_by_year.parquet' where element like 'T%' group by all having v between -900 and 600 and d is not null order by 1, 2, 3""").df()
    groups = [(g["d"].to_numpy(), g["v"].to_numpy(float)) for _, g in d.groupby(["s", "e"])]
    count = lambda: sum(int((spike_scores(a, b, "level") > SPIKE_LEVEL).sum()) for a, b in groups)
    full = count()
    without_low_rank(monkeypatch)
    assert count() < full


def test_heavy_rain_is_usual():
    rng = np.random.default_rng(3)
    v = np.where(rng.random(300) < 0.3, rng.gamma(0.8, 80, 300), 0.0).round()
    assert (spike_scores(np.arange(300), v, "amount") < SPIKE_AMOUNT).all()
    v[50] = 30 * np.quantile(v[v > 0], 0.9)
    assert np.nonzero(spike_scores(np.arange(300), v, "amount") > SPIKE_AMOUNT)[0].tolist() == [50]
    assert (spike_scores(np.arange(3), np.zeros(3), "amount") == 0).all()


def test_short_and_constant_series():
    for kind in ("level", "amount"):
        for v in ([], [5.0], [5.0, 5.0], [3.0] * 40, [0.0, 7.0]):
            s = spike_scores(np.arange(len(v)), np.array(v), kind)
            assert len(s) == len(v) and np.isfinite(s).all() and (s < SPIKE_AMOUNT).all()


def test_stuck():
    v = np.array([1, 2, 2, 2, 2, 2, 2, 2, 3] + [0] * 9 + [5] * 6, float)
    assert np.nonzero(stuck(v))[0].tolist() == list(range(1, 8))


def obs(day, v, sid="s", el="TMAX"):
    return (sid, (dt.date(2020, 1, 1) + dt.timedelta(days=int(day))).strftime("%Y%m%d") if day is not None and not isinstance(day, str) else day, el, v, "x", "clash", "clash")


def test_end_to_end_with_dirt(spark):
    rng = np.random.default_rng(4)
    day, v = series(rng)
    rows = [obs(d, f" {x:.0f}.0 " if i % 3 else f"{x:.0f}") for i, (d, x) in enumerate(zip(day, v))]
    rows[40] = obs(day[40], str(v[40] - 330))
    rows += [rows[40], obs(900, "-9999"), obs("20201399", "9999"), obs("20201399", "5"), obs(901, None), obs(902, ""), obs(903, "nan"), obs(904, "inf"), obs(None, "100")]
    rows += [obs(1000 + i, "7" if i != 3 else None, el="XX") for i in range(8)] + [obs(2000 + i, "7", el=None, sid=None) for i in range(6)]
    got = {(r["station_id"], r["date"], r["element"]): r for r in implausible(spark.createDataFrame(rows, SCHEMA)).collect()}
    spike = rows[40][:3]
    assert got[spike]["spike"] and not got[spike]["impossible"]
    assert {k for k, r in got.items() if r["impossible"]} == {obs(900, "")[:3], obs("20201399", "")[:3]}
    assert {k for k, r in got.items() if r["stuck"]} == {obs(1000 + i, "", el="XX")[:3] for i in range(8) if i != 3}
    assert len(got) == 10


def test_empty(spark):
    assert implausible(spark.createDataFrame([], SCHEMA)).count() == 0
