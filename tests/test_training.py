import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import forecast, training, windows
from gridspark.operators.training import Shape, State, batch_gradient, errors_and_gradient, fit, flat, metrics_table, options, unflat
from tests.test_reference import small_cube

RNG = np.random.default_rng(3)


def one(l_in=3, l_out=2, c=2, n=4):
    flag = RNG.integers(0, 3, (l_out, n, n))
    return RNG.normal(0, 1, (l_in, c, n, n)), RNG.normal(0, 1, (l_out, n, n)), flag, RNG.normal(0, 1, (l_in, 2)), RNG.normal(0, 1, (l_out, 2))


@pytest.mark.parametrize(("two", "doy", "dropout"), [(False, True, 0), (False, False, 0), (True, True, 0), (True, True, 0.3)])
def test_gradient_is_the_slope(two, doy, dropout):
    w = forecast.random_weights(2, 3, two_layers=two, doy=doy)
    x, y, flag, dx, dy = one()
    if not doy:
        dx = dy = None
    run = lambda v: errors_and_gradient(v, x, y, flag, dx, dy, dropout, np.random.default_rng(1))
    e, g = run(w)
    if not dropout:
        out = forecast.run_network(w, x, dx, dy, 2)[:, 0]
        assert np.allclose(np.where(flag == 1, out - y, 0), np.nan_to_num(e)) and (np.isnan(e) == (flag != 1)).all()
    base, slope = flat(w), flat(g)
    for i in RNG.choice(base.size, 60, replace=False):
        side = []
        for d in (1e-5, -1e-5):
            v = base.copy()
            v[i] += d
            side.append(0.5 * np.nansum(run(unflat(v, w))[0] ** 2))
        assert slope[i] == pytest.approx((side[0] - side[1]) / 2e-5, abs=1e-5, rel=1e-4)


@pytest.fixture(scope="module")
def samples(spark):
    spec = windows.WindowSpec(12, 4, 4, 3, 2, 1, 2)
    d = small_cube(spark, 12)
    index = windows.batches(windows.sample_index(spec, windows.valid_patches(d, spec, 0.0)), 8, seed=1)
    s = windows.materialise(d, spec, ["LAI_norm"], "LAI_norm", "LAI_flag", index).join(index.select("sample_id", "batch"), "sample_id")
    return s.cache(), Shape(3, 2, 1, 2, 2)


def test_gradient_over_tasks_is_that_of_one_task(spark, samples):
    s, shape = samples
    w = forecast.random_weights(1, 2)
    part = s.filter("batch = 0")
    a, b = batch_gradient(part.repartition(3), w, shape), batch_gradient(part.coalesce(1), w, shape)
    assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1])
    got = [errors_and_gradient(w, *shape.tensors(r)) for r in part.collect()]
    n = sum((~np.isnan(e)).sum() for e, _ in got)
    assert a[0] == pytest.approx(sum(np.nansum(e * e) for e, _ in got) / n) and np.allclose(a[1], 2 * sum(flat(g) for _, g in got) / n)
    assert batch_gradient(s.filter("batch = 99"), w, shape)[0] == 0.0


def test_training_learns_stops_and_goes_on(spark, samples, tmp_path):
    s, shape = samples
    train, val = s.filter("batch < 3"), s.filter("batch >= 3")
    w = forecast.random_weights(1, 2, seed=4)
    first, second = tmp_path / "a", tmp_path / "b"
    first.mkdir(), second.mkdir()
    best, history = fit(train, val, shape, w, 4, lr=0.02, folder=str(first), checkpoint_epochs=2)
    assert history[-1]["train_loss"] < 0.8 * history[0]["train_loss"] and len(history) == 4
    assert sorted(p.name for p in first.iterdir()) == ["best_model.npz", "checkpoint_0000.npz", "checkpoint_0002.npz"]
    # going on after epoch 2 gives what the whole run gave
    again, rest = fit(train, val, shape, w, 4, lr=0.02, folder=str(second), resume=str(first))
    assert [h["epoch"] for h in rest] == [3] and rest[0]["val_loss"] == pytest.approx(history[3]["val_loss"])
    m = metrics_table(spark, history)
    assert m.filter("metric = 'rmse'").count() == 8 and m.filter("metric = 'lr'").agg(F.min("value")).first()[0] == 0.02
    _, short = fit(train, val, shape, w, 9, lr=0.0, patience=2)
    assert len(short) == 3  # the first epoch is the best, then two without gain


def test_schedule_and_steps():
    s = State({"a": np.ones(2)}, 0.01)
    s.adam(np.array([3e3, 4e3]))
    assert np.linalg.norm(s.m) == pytest.approx(0.1, rel=1e-6) and flat(s.w) == pytest.approx(1 - 0.01, rel=1e-4)
    for _ in range(9):
        s.plateau(1.0, 7)
    assert s.lr == 0.005
    o = options(["--config", "c.yaml", "--resume", "--accumulation-steps", "4"])
    assert (o.config, o.resume, o.accumulation_steps, o.checkpoint_epochs, o.profile) == ("c.yaml", True, 4, 5, False)


def test_two_batches_in_one_step(spark, samples):
    s, shape = samples
    w = forecast.random_weights(1, 2, seed=5)
    assert training.fit(s.filter("batch < 2"), s.filter("batch = 3"), shape, w, 1, accumulation=2)[1][0]["train_loss"] > 0
