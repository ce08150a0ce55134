"""Golden values and invariants of the reference operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.config import RunConfig, latest_checkpoint
from gridspark.functions.geo import Laea
from gridspark.functions.missing import clean_floats
from gridspark.functions.scalar import GROUPS_5, doy_encoding, log_zscore, log_zscore_inverse, one_hot, to_half
from gridspark.operators import align, features, forecast, interp, metrics, regrid, windows
from gridspark.operators.grid import Grid, mesh
from gridspark.sources import cube as cubes
from gridspark.sources import stations as st
from gridspark.streaming import daily

DAY = dt.date(2021, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_barnes(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("b", 30.0, 0.0), ("c", 0.0, 40.0), ("d", 60.0, 80.0)], "station_id string, x double, y double")
    o = spark.createDataFrame([(DAY, k, v) for k, v in zip("abcd", (10.0, 14.0, 20.0, 30.0))] + [(DAY, "a", float("nan")), (day(1), "a", 5.0)], "date date, station_id string, value double")
    n = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 1, 20.0, 20.0), (2, 2, 40.0, 40.0)], "iy int, ix int, x double, y double")
    assert interp.BARNES_KAPPA == pytest.approx(319.28645)
    one = {r["iy"]: r["value"] for r in interp.barnes(o, s, n, passes=1).collect()}
    two = {r["iy"]: r["value"] for r in interp.barnes(o, s, n).collect()}
    assert one == pytest.approx({0: 10.286348, 1: 14.438702, 2: 19.211156}, abs=1e-5)
    assert two == pytest.approx({0: 10.000042, 1: 14.635003, 2: 19.318670}, abs=1e-5)


def test_idw(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 6.0, 8.0), ("d", 100.0, 0.0)], "station_id string, x double, y double")
    o = spark.createDataFrame([(DAY, k, v) for k, v in zip("abcd", (0.0, 2.0, 7.0, 50.0))] + [(DAY, "d", -1.0)], "date date, station_id string, value double")
    n = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 3.0, 0.0), (2, 0, 50.0, 4.0)], "iy int, ix int, x double, y double")
    got = {r["iy"]: r["value"] for r in interp.idw_log(o, s, n).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.679764}, abs=1e-5)


def test_gap_fill(spark):
    d = spark.createDataFrame([(DAY, 0, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "time date, iy int, ix int, v double")
    fill = lambda g: [r["v"] for r in interp.fill_gaps(d, "v", ["time", "iy"], "ix", g).orderBy("ix").collect()]
    assert fill(3) == [None, 2.0, 4.0, 6.0, 8.0, None] and fill(2) == [None, 2.0, None, None, 8.0, None]
    assert interp.fill_gaps_2d(d.withColumns({"x": F.col("ix") * 1000.0, "y": F.lit(0.0)}), "v", 3, units="coord").filter("v IS NOT NULL").count() == 2


def test_bilinear_of_a_plane(spark):
    g = Grid(0.0, 0.0, 10.0, 5, 4)
    c = g.coarse(20.0)
    assert (c.nx, c.ny) == (3, 2)
    nodes = c.cells(spark).select(F.lit(DAY).alias("date"), "iy", "ix", (F.col("x") * 2 + F.col("y")).alias("value"))
    got = interp.bilinear(nodes, c, g.cells(spark)).collect()
    assert len(got) == 15 and all(r["value"] == pytest.approx(r["ix"] * 20 + r["iy"] * 10) for r in got)


def test_laea(spark):
    p = Laea.for_box(26, 37, -107.75, -93)
    assert p.crs == "+proj=laea +lat_0=31.5000 +lon_0=-100.3750 +datum=WGS84 +units=m"
    pts = [(31.5, -100.375, 0, 0), (26, -108, -763250.586755, -583965.392357), (37, -93, 656397.214516, 632697.172862), (30, -97, 325576.841380, -161361.368689)]
    d = spark.createDataFrame([(float(a), float(b)) for a, b, *_ in pts], "lat double, lon double")
    x, y = p.forward(F.col("lat"), F.col("lon"))
    d = d.withColumns({"x": x, "y": y})
    lat, lon = p.inverse(F.col("x"), F.col("y"))
    for r, (a, b, x, y) in zip(d.withColumns({"la": lat, "lo": lon}).collect(), pts):
        assert (r["x"], r["y"]) == pytest.approx((x, y), abs=1e-3)
        assert p.forward_point(a, b) == pytest.approx((x, y), abs=1e-3)
        assert (r["la"], r["lo"]) == pytest.approx((a, b), abs=1e-7)


def test_grid(spark):
    g = Grid.for_box(26, 37, -107.75, -93, 1000.0)
    assert g.x0 % 1000 == 0 and g.nx > 1000 and g.ny > 1000
    s = Grid(0.0, 0.0, 10.0, 3, 2)
    iy, ix = s.key(F.col("x"), F.col("y"))
    d = spark.createDataFrame([(-5.0, -5.0), (24.9, 14.9), (25.0, 0.0), (0.0, -5.1)], "x double, y double")
    assert [tuple(r) for r in d.select(iy, ix).collect()] == [(0, 0), (1, 2), (None, None), (None, None)]
    assert s.cells(spark).count() == 6 and cubes.grid_of(s.cells(spark)) == s
    m = mesh(spark.createDataFrame([(0, 1.0), (1, 2.0)], "iy int, lat double"), spark.createDataFrame([(0, 5.0)], "ix int, lon double"))
    assert m.count() == 2
    assert s.cells_geographic(spark, Laea(30.0, -100.0)).filter("abs(lat - 30) < 0.01").count() == 6


def test_majority_and_mean(spark):
    d = spark.createDataFrame([(0, v) for v in (3.0, 2.0, 2.0, 3.0, float("nan"))] + [(1, None)], "cell int, v double")
    cells = spark.createDataFrame([(0,), (1,), (2,)], "cell int")
    assert {r["cell"]: r["v"] for r in regrid.bucket_mode(d, ["cell"], "v", cells).collect()} == {0: 2.0, 1: None, 2: None}
    assert {r["cell"]: r["v"] for r in regrid.bucket_mean(d, ["cell"], "v", cells).collect()} == {0: 2.5, 1: None, 2: None}


def test_qc(spark):
    d = spark.createDataFrame([(0, 0), (8, 0), (0, 1), (None, 0), (0, None)], "qc int, ex int")
    v = regrid.qc_mask(F.lit(1.0), F.col("qc"), F.col("ex"))
    assert [r[0] for r in d.select(v).collect()] == [1.0, None, None, 1.0, None]


def test_scalars(spark):
    d = spark.createDataFrame([("2021-01-01",), ("2021-04-01",), ("2021-12-31",), ("2020-12-31",)], "d string").select(F.to_date("d").alias("d"))
    got = [tuple(r) for r in d.select(*doy_encoding(F.col("d"))).collect()]
    for r, w in zip(got, [(0.017213, 0.999852), (0.999991, 0.004304), (0, 1), (0.017213, 0.999852)]):
        assert r == pytest.approx(w, abs=1e-6)
    c = spark.createDataFrame([(x,) for x in (0, 1, 4, 5, 6, 7, 8, 11, 255, None)], "c int")
    assert [tuple(r) for r in c.select(*one_hot(F.col("c"))).collect()] == [(0,) * 6, (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1)] + [(0,) * 6] * 3
    assert [sum(r) for r in c.select(*one_hot(F.col("c"), GROUPS_5, others="others")).collect()] == [1] * 10
    f = features.land_cover_groups(c, "c")
    assert features.group_fractions(f).first()["most"] == 1
    z = spark.createDataFrame([(3.0,)], "v double").select(log_zscore_inverse(log_zscore(F.col("v"), 0.5, 2.0), 0.5, 2.0)).first()[0]
    assert z == pytest.approx(3.0)


def test_half_precision_like_numpy(spark):
    v = [0.0, -0.1, 1 / 3, 65504.0, 65519.0, 65520.0, 1e-7, 3e-8, 2049.0, 2051.0, -1e9, 6.1e-5, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v double").select(to_half(F.col("v"))).collect()]
    with np.errstate(over="ignore"):
        assert got == [None if x is None else float(np.float16(x)) for x in v]


def test_rolling_with_missing(spark):
    d = spark.createDataFrame([(day(i), 0, 0, v) for i, v in enumerate([1.0, None, 3.0, None, None, None, 5.0])], "time date, iy int, ix int, p double")
    assert [r[0] for r in d.select(features.rolling_sum(F.col("p"), 4).alias("s"), "time").orderBy("time").collect()] == [None, None, 4.0, 4.0, None, None, None]
    n = features.rolling_norms(d, "p", [4], None).orderBy("time").collect()
    assert n[0]["p_4d_norm"] == 0.0


def test_population_deviation_and_percentiles(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "v double")
    assert features.train_stats(d, {"v": F.col("v")})["v"] == pytest.approx((2.0, 0.816497), abs=1e-6)
    s = interp.spacing_summary(d.filter("v < 9"), "v").first()
    assert s["p10"] == pytest.approx(1.2) and s["std"] == pytest.approx(0.816497, abs=1e-6)
    assert features.stats_table(d, {"v": (1.0, None)}).count() == 1 and clean_floats(d).filter("v IS NULL").count() == 1


def test_spacing(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 3.0, 4.0), ("d", 500.0, 0.0), ("e", None, 1.0)], "k string, x double, y double")
    assert {r["k"]: r["spacing"] for r in interp.nearest_spacing(d, "k", "x", "y").collect()} == pytest.approx({"a": 5.0, "b": 0.0, "c": 0.0, "d": math.hypot(497, 4)})
    assert {r["k"]: r["spacing"] for r in interp.nearest_spacing(d, "k", "x", "y", 2).collect()}["b"] == pytest.approx(2.5)
    assert interp.nearest_spacing(d.limit(1), "k", "x", "y").first()["spacing"] is None


def test_asof_daily(spark):
    d = spark.createDataFrame([(DAY, 0, 0, 0.5, 1), (DAY, 0, 1, 0.0, 0), (day(4), 0, 0, 0.0, 0)], "time date, iy int, ix int, LAI_norm double, LAI_flag int")
    got = align.asof_daily(d).orderBy("ix", "time").collect()
    assert [(r["LAI_norm"], r["LAI_flag"]) for r in got if r["ix"] == 0] == [(0.5, 1), (0.5, 2), (0.5, 2), (0.5, 2), (0.0, 0)]
    assert [r["LAI_flag"] for r in got if r["ix"] == 1] == [0, 2, 2, 2]


def test_asof_year(spark):
    y = spark.createDataFrame([(dt.date(2003, 1, 1),), (dt.date(2004, 1, 1),)], "year_start date")
    d = spark.createDataFrame([(dt.date(2002, 6, 1),), (dt.date(2003, 6, 1),), (dt.date(2010, 6, 1),)], "date date")
    assert [r["lc_year"].year for r in align.asof_year(d, y).orderBy("date").collect()] == [2003, 2003, 2004]
    assert align.asof_year(d.limit(0), y).count() == 0


def test_alignment_guards(spark):
    a = spark.createDataFrame([(DAY, 0, 0, 1.0, 2.0)], "time date, iy int, ix int, v double, weather_flag double")
    b = a.withColumn("time", F.date_add("time", 1))
    with pytest.raises(ValueError):
        align.inner_align([a.drop("v"), b])
    with pytest.raises(ValueError):
        align.replace_variable(a, b, "v")
    assert align.replace_variable(a, a.withColumn("v", F.lit(9.0)), "v").first()["v"] == 9.0
    with pytest.raises(ValueError):
        align.select_variables(a, ["v", "w"])
    with pytest.raises(ValueError):
        align.land_cover_columns(a)
    with pytest.raises(ValueError):
        align.flag_columns(a.drop("weather_flag"))
    assert align.flag_columns(a) == ["weather_flag"] and align.drop_variables(a, ["v", "nope"]).columns == ["time", "iy", "ix", "weather_flag"]
    assert align.rename_dimensions(a.withColumns({"y": F.lit(1), "x": F.lit(2)})).columns[-2:] == ["lat", "lon"]


def test_combine_flags_and_padding(spark):
    d = spark.createDataFrame([(1, 1)] * 39 + [(1, 0)], "temp_flag int, prcp_flag int")
    assert features.flag_agreement(d).first()["disagreement"] == pytest.approx(0.025)
    assert features.combine_flags(d).agg(F.sum("weather_flag")).first()[0] == 39
    assert "weather_flag" not in features.combine_flags(d, limit=0.02).columns
    y = spark.createDataFrame([(2020, "a"), (2021, "b")], "year int, v string")
    assert sorted((r["year"], r["v"]) for r in features.pad_last_year(y, "year", 2025).collect()) == [(2020, "a"), (2021, "b"), (2025, "b")]
    assert features.pad_last_year(y, "year", 2021).count() == 2


def test_windows(spark):
    w = windows.WindowSpec(60, 7, 5, 14, 14, 14, 2)
    assert w.n_sequences == 3 and w.patches == (3, 2) and w.n_samples == 18
    seq, lat, lon = w.of_sample(F.lit(7))
    assert tuple(spark.range(1).select(seq, lat, lon).first()) == (1, 1, 0)
    cube = spark.range(60).select(F.col("id").cast("int").alias("it"))
    got = windows.sequence_windows(cube, w).groupBy("seq").agg(F.min("it"), F.max("it"), F.count_if(F.col("role") == "y")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(0, 0, 27, 14), (1, 14, 41, 14), (2, 28, 55, 14)]
    index = windows.sample_index(w, windows.valid_patches(cube, w, 0.0))
    assert index.count() == 18 and index.agg(F.count_distinct("sample_id")).first()[0] == 18
    a, b = windows.sample_subset(index, 10, 0.75)
    assert (a.count(), b.count(), a.join(b, "sample_id").count()) == (7, 3, 0)


def small_cube(spark, steps=8, ny=4, nx=4):
    d = spark.range(steps * ny * nx).select(F.floor(F.col("id") / (ny * nx)).cast("int").alias("it"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return d.select(F.date_add(F.lit(DAY), F.col("it")).alias("time"), "it", "iy", "ix", F.sin(F.col("it") + F.col("iy") * 3 + F.col("ix")).cast("float").alias("LAI_norm"), F.lit(1).alias("LAI_flag"))


def test_materialised_sample(spark):
    d, w = small_cube(spark), windows.WindowSpec(8, 4, 4, 3, 2, 1, 2)
    s = {r["sample_id"]: r for r in windows.materialise(d, w, ["LAI_norm", "it"], "LAI_norm", "LAI_flag").collect()}
    assert len(s) == w.n_samples == 16
    r = s[4 * 2 + 2 * 1 + 0]
    x = np.array(r["x"]).reshape(3, 2, 2, 2)
    yy, xx = np.meshgrid([0, 1], [2, 3], indexing="ij")
    assert x[1, 0] == pytest.approx(np.sin(3 + yy * 3 + xx), abs=1e-6) and (x[:, 1] == np.array([2, 3, 4])[:, None, None]).all()
    assert np.array(r["y"]).reshape(2, 2, 2)[0] == pytest.approx(np.sin(5 + yy * 3 + xx), abs=1e-6)
    assert r["flag_y"] == [1] * 8 and len(r["doy_x"]) == 6 and len(r["doy_y"]) == 4
    x_part, y_part = windows.sample_cells(d, w, 10)
    assert (x_part.count(), y_part.count()) == (12, 8)
    assert windows.materialise(d, w, ["LAI_norm"], "LAI_norm", None).first()["flag_y"] == [0] * 8


@pytest.mark.parametrize("two", [False, True])
def test_tiled_network_equals_whole_area(spark, two):
    d, w = small_cube(spark, 5, 11, 9), windows.WindowSpec(5, 11, 9, 2, 1)
    weights = forecast.random_weights(1, 2, two_layers=two)
    key = lambda df: {(r["seq"], r["lead"], r["iy"], r["ix"]): r["pred"] for r in df.collect()}
    tiled, whole = key(forecast.predict(d, w, ["LAI_norm"], weights, tile=3)), key(forecast.predict(d, w, ["LAI_norm"], weights, tile=64))
    assert len(whole) == 3 * 99 and tiled == pytest.approx(whole, abs=1e-9)
    back = forecast.load_weights(forecast.save_weights(spark, weights))
    assert all((back[k] == v).all() for k, v in weights.items())


def test_convolution_and_parameters(spark):
    x = np.arange(9.0).reshape(1, 3, 3)
    assert forecast.conv2d(x, np.ones((1, 1, 3, 3)), np.zeros(1))[0].tolist() == [[8, 15, 12], [21, 36, 27], [20, 33, 24]]
    for two, n in ((False, 26067), (True, 63059)):
        assert metrics.parameter_count(forecast.save_weights(spark, forecast.random_weights(10, 16, two_layers=two))).first()[0] == n
    assert forecast.run_network(forecast.random_weights(1, 2, doy=False), np.zeros((3, 1, 4, 4)), None, None, 2).shape == (2, 1, 4, 4)


def test_forecast_cube(spark):
    d = small_cube(spark, 30, 1, 1)
    p = spark.createDataFrame([(s, k, 0, 0, 7.0) for s in range(3) for k in range(1, 15)], "seq int, lead int, iy int, ix int, pred double")
    f = forecast.forecast_cube(d, p, 14, 14)
    assert f.select("init_date").distinct().count() == 17
    assert f.filter("lead > 0 AND LAI_norm = 7").select("init_date").distinct().count() == 3
    assert f.filter("lead > 0 AND LAI_norm = 0").count() == 14 * 14 and f.filter("lead = 0").count() == 17
    assert forecast.forecast_cube(d, p, 14, 14, "null").filter("LAI_norm IS NULL").count() == 14 * 14
    assert forecast.forecast_cube(d, p, 14, 14, "drop", leads=forecast.Leads(2, 3)).count() == 6
    for a, b in ((0, 1), (3, 2), (1, 15)):
        with pytest.raises(ValueError):
            forecast.forecast_cube(d, p, 14, 14, leads=forecast.Leads(a, b))
    both, offset = forecast.append_period(f.filter("init_date < '2021-01-20'"), f)
    assert both.count() == f.count() and offset == 6


def test_masked_metrics(spark):
    d = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 4.0, 1), (3.0, 9.0, 2)], "pred double, true double, flag int")
    r = metrics.masked_metrics(d).first()
    assert (r["mse"], r["mae"], r["n_valid"]) == (2.0, 1.0, 2) and r["rmse"] == pytest.approx(1.414214, abs=1e-6)
    assert tuple(metrics.masked_metrics(d.filter("flag = 2")).first()) == (0.0, 0.0, 0.0, 0) and metrics.masked_mse(d.filter("flag = 2")).first()[0] == 0.0


def test_station_files(spark, tmp_path):
    (tmp_path / "2020.csv").write_text("A,20200101,TMAX,123,,,N,0700\nA,20200101,PRCP,55,,,N,\nB,20200101,TMAX,x,,,N,\nA,2020x,TMAX,1,,,,\n")
    (tmp_path / "ids.txt").write_text("A\n\n  A \nB\n")
    (tmp_path / "st.txt").write_text("QXR00009975  37.8719  -93.7143   85.7 WENTONA RANCH\nshort\nQXR00009976  37.8719  -93.7143        NAME\nQXR00009977  37.8x19  -93.7143   85.7 BAD\n")
    o = st.typed_observations(st.scan_observations(spark, str(tmp_path / "2020.csv")), st.scan_station_ids(spark, str(tmp_path / "ids.txt")))
    assert sorted((r["element"], r["value"]) for r in o.collect()) == [("PRCP", 55.0), ("TMAX", 12.3)]
    assert [(r["station_id"], r["elev"], r["name"]) for r in st.scan_stations(spark, str(tmp_path / "st.txt")).collect()] == [("QXR00009975", 85.7, "WENTONA RANCH"), ("QXR00009976", None, "NAME")]
    cubes.write_by_variable_year(o, str(tmp_path / "out"))
    assert (tmp_path / "out" / "element=TMAX" / "year=2020").exists()
    (tmp_path / "v.csv").write_text("station_id,date,tmax\n1,2020-01-01,5\n1,20200102,6\n")
    v = st.scan_variable(spark, [str(tmp_path / "v.csv"), str(tmp_path / "none.csv")], "tmax")
    assert [tuple(r) for r in v.orderBy("date").collect()] == [("1", dt.date(2020, 1, 1), 5.0), ("1", dt.date(2020, 1, 2), 6.0)]
    cubes.write_station_ids(o, str(tmp_path / "ids_out"))
    assert st.scan_station_ids(spark, str(tmp_path / "ids_out")).count() == 1


def test_cube_on_disk(spark, tmp_path):
    path, d = str(tmp_path / "cube"), small_cube(spark).drop("it")
    cubes.create_cube(d.filter("time < '2021-01-05'"), path, tile=2)
    with pytest.raises(Exception, match="(?i)exists"):
        cubes.create_cube(d, path)
    for _ in range(2):
        cubes.append_cube(d, path)
    got = cubes.scan_cube(spark, path)
    assert got.count() == d.count() and set(got.columns) == set(d.columns)
    assert cubes.scan_cube(spark, path, "2021-01-02", "2021-01-03", ["LAI_norm"]).count() == 32
    root = str(tmp_path / "vars")
    cubes.put_variables(d.select("time", "iy", "ix", "LAI_norm"), root, "norm")
    cubes.put_variables(d.select("time", "iy", "ix", "LAI_flag"), root, "flag")
    cubes.put_variables(d.select("time", "iy", "ix", F.lit(2).alias("LAI_flag")), root, "flag")
    assert cubes.open_variables(spark, root, ["norm", "flag"]).agg(F.sum("LAI_flag")).first()[0] == 2 * d.count()
    cubes.write_grid(spark, Grid(0.0, 1.0, 2.0, 3, 4, "crs"), str(tmp_path / "grid"))
    assert cubes.read_grid(spark, str(tmp_path / "grid")) == Grid(0.0, 1.0, 2.0, 3, 4, "crs")


def test_streaming(spark, tmp_path):
    src, cube = str(tmp_path / "in"), str(tmp_path / "cube")
    d = small_cube(spark).drop("it")
    d.filter("time < '2021-01-04'").write.parquet(src)
    schema = "time date, iy int, ix int, LAI_norm float, LAI_flag int"
    for extra in (None, "2021-01-03"):
        if extra:
            d.filter(F.col("time") >= extra).write.mode("append").parquet(src)
        daily.grow_cube(daily.read_arrivals(spark, src, schema), cube, str(tmp_path / "check")).awaitTermination(120)
    assert cubes.scan_cube(spark, cube).count() == d.count()
    ev = spark.createDataFrame([(dt.datetime(2021, 1, 1, 5), "a", 1.0), (dt.datetime(2021, 1, 1, 6), "a", 2.0), (dt.datetime(2021, 1, 9), "a", 4.0)], "ts timestamp, k string, v double")
    ev.write.parquet(str(tmp_path / "ev"))
    s = daily.windowed_totals(daily.read_arrivals(spark, str(tmp_path / "ev"), "ts timestamp, k string, v double"), "ts", ["k"], "v")
    s.writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["total"], r["n"]) for r in spark.table("totals").collect()] == [(3.0, 2)]
    assert daily.windowed_totals(ev, "ts", ["k"], "v").count() == 2


def test_streaming_split_step(spark, tmp_path):
    """Cells of one time step in files of several batches, one of them repeated in a later file, one without a row number."""
    src, cube, check = (str(tmp_path / x) for x in ("in", "cube", "check"))
    schema = "time date, iy int, ix int, LAI_norm float"
    day, late = dt.date(2021, 1, 1), dt.date(2020, 12, 31)
    files = [[(day, 0, 0, 1.0)], [(day, 0, 1, 2.0)], [(day, 0, 0, 9.0), (day, 1, 0, 3.0), (day, None, 0, 5.0)], [(late, 0, 0, 4.0), (day, None, 0, 5.0)]]
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    daily.grow_cube(daily.read_arrivals(spark, src, schema, files_at_once=1), cube, check).awaitTermination(120)
    daily.grow_cube(daily.read_arrivals(spark, src, schema), cube, str(tmp_path / "again")).awaitTermination(120)
    got = [tuple(r) for r in cubes.scan_cube(spark, cube).select("time", "iy", "ix").collect()]
    assert sorted(got, key=str) == sorted([(late, 0, 0), (day, 0, 0), (day, 0, 1), (day, 1, 0), (day, None, 0)], key=str)


def test_config(tmp_path):
    c = {"dataset": {"data": {"path": "/x"}, "features": ["a", "LAI_norm"], "lc_features": ["lc_grass"], "input_seq_length": 14}, "root_dir": str(tmp_path), "train_test_split": 0.8}
    r = RunConfig.from_dict(c)
    assert r.dataset.target_index == 1 and r.dataset.n_input_channels == 3 and r.dataset.target_seq_length == 15 and r.val_start == "2022-01-01"
    r.dump(str(tmp_path / "c.json"))
    assert RunConfig.load(str(tmp_path / "c.json")) == r and r.run_dir().exists()
    assert latest_checkpoint(["a/checkpoint_010.pth", "a/checkpoint_002.pth", "a/best.pth"]) == "a/checkpoint_010.pth" and latest_checkpoint([]) is None


def test_spacing_of_repeated_keys_ends(spark):
    """Rows of one key only, keys at several positions, towns beside lonely points."""
    d = spark.createDataFrame([("a", 0.0, 0.0), ("a", 5.0, 0.0)], "k string, x double, y double")
    assert [r["spacing"] for r in interp.nearest_spacing(d, "k", "x", "y").collect()] == [None]
    rng = np.random.default_rng(3)
    pts = [(f"p{i}", *v) for i, v in enumerate(np.concatenate([rng.normal(0, 0.01, (80, 2)), rng.uniform(-500, 500, (40, 2)), np.zeros((3, 2))]).tolist())]
    pts += [("p0", 300.0, 300.0), ("p1", *pts[1][1:])]
    for k in (1, 3):
        got = {r["k"]: r["spacing"] for r in interp.nearest_spacing(spark.createDataFrame(pts, "k string, x double, y double"), "k", "x", "y", k).collect()}
        for name in {p[0] for p in pts}:
            best = {}
            for q in pts:
                if q[0] != name:
                    best[q[0]] = min([best.get(q[0], 1e9)] + [math.hypot(q[1] - p[1], q[2] - p[2]) for p in pts if p[0] == name])
            assert got[name] == pytest.approx(np.mean(sorted(best.values())[:k]), abs=1e-9)


def test_barnes_and_idw_like_a_loop(spark, monkeypatch):
    """Several blocks and stretches, targets in small portions, missing days, a station on a node."""
    monkeypatch.setattr(interp, "STRETCH", 3)
    monkeypatch.setattr(interp, "AT_ONCE", 4)
    rng = np.random.default_rng(6)
    where = {f"s{i}": v for i, v in enumerate(rng.uniform(0, 100, (40, 2)).tolist())} | {"on": [20.0, 20.0], "also": [20.0, 20.0]}
    obs = {(d, s): float(rng.gamma(1, 5)) for d in range(8) for s in where if rng.random() < 0.7}
    o = spark.createDataFrame([(DAY + dt.timedelta(days=d), s, v) for (d, s), v in obs.items()] + [(DAY, "s0", float("nan")), (None, "s0", 1.0)], "date date, station_id string, value double")
    st_ = spark.createDataFrame([(s, *v) for s, v in where.items()], "station_id string, x double, y double")
    nodes = {(i, j): (10.0 * j, 10.0 * i) for i in range(11) for j in range(11)}
    n = spark.createDataFrame([(*k, *v) for k, v in nodes.items()], "iy int, ix int, x double, y double")
    r, k = 12.0, 40.0

    def near(x, y, d):
        return sorted((s, (a - x) ** 2 + (b - y) ** 2, obs[d, s]) for s, (a, b) in where.items() if (d, s) in obs and (a - x) ** 2 + (b - y) ** 2 <= r * r)

    def mean(rows, width):
        w = [math.exp(-q / width) for _, q, _ in rows]
        return sum(a * v for a, (*_, v) in zip(w, rows)) / sum(w)

    first = {(d, s): mean(near(*where[s], d), k) for d, s in obs}
    want_b, want_i = {}, {}
    for d in range(8):
        for key, (x, y) in nodes.items():
            rows = near(x, y, d)
            if len(rows) >= 3:
                want_b[d, key] = mean(rows, k) + mean([(s, q, v - first[d, s]) for s, q, v in rows], 0.3 * k)
                hit = [v for s, q, v in rows if q == 0]
                w = [(1 / q, math.log1p(v)) for s, q, v in rows if q > 0]
                v = hit[0] if hit else math.expm1(sum(a * b for a, b in w) / sum(a for a, _ in w))
                want_i[d, key] = 0.0 if v < 0.1 else v
    for got, want in ((interp.barnes(o, st_, n, r, k), want_b), (interp.idw_log(o, st_, n, r), want_i)):
        g = {((x["date"] - DAY).days, (x["iy"], x["ix"])): x["value"] for x in got.collect()}
        assert set(g) == set(want) and all(g[x] == pytest.approx(want[x], abs=1e-9) for x in want)


@pytest.mark.parametrize("seed", [None, 3])
def test_batches_have_the_size_asked_for(spark, seed):
    index = spark.range(1003).select((F.col("id") * 7).alias("sample_id"))
    got = windows.batches(index, 64, seed)
    assert sorted(r["count"] for r in got.groupBy("batch").count().collect()) == [43] + [64] * 15
    rows = {r["sample_id"]: r["batch"] for r in got.collect()}
    assert len(rows) == 1003 and ([rows[i * 7] for i in range(1003)] == [i // 64 for i in range(1003)]) == (seed is None)


def test_samples_with_gaps_and_land_cover(spark):
    """A step without any cell is zeros, land cover is that of the year in which the window starts."""
    d, w = small_cube(spark, 8, 2, 2).withColumn("time", F.add_months("time", F.col("it") * 5)), windows.WindowSpec(8, 2, 2, 2, 1, 1, 2)
    gone = d.filter("it <> 3 OR (iy = 0 AND ix = 0 AND false)").unionByName(d.filter("it = 3").withColumns({"iy": F.lit(9), "ix": F.lit(9)}))
    first = {r["it"]: r["time"] for r in d.select("it", "time").distinct().collect()}
    years = sorted({t.year for t in first.values()})[1:3]
    lc = spark.createDataFrame([(dt.date(y, 1, 1), i, j, y - 2000, i) for y in years for i in range(2) for j in range(2)], "year_start date, iy int, ix int, lc_a int, lc_b int")
    s = {r["seq"]: r for r in windows.materialise(gone, w, ["LAI_norm"], "LAI_norm", "LAI_flag", land_cover=lc, land_cover_features=["lc_a", "lc_b"]).collect()}
    assert len(s) == w.n_sequences == 6
    for q, r in s.items():
        x = np.array(r["x"]).reshape(2, 3, 2, 2)
        year = min(max(first[q].year, years[0]), years[1])
        assert (x[:, 1] == year - 2000).all() and (x[:, 2] == np.array([[0, 0], [1, 1]])).all()
        assert (x[3 - q if 0 <= 3 - q < 2 else 0, 0] == 0).all() == (q in (2, 3))
        assert len(r["doy_x"]) == 4 and len(r["y"]) == 4 and (r["y"] == [0.0] * 4) == (q == 1) and (r["flag_y"] == [0] * 4) == (q == 1)


def test_planes_of_groups_larger_than_a_batch(spark):
    d = spark.range(50_000).select((F.col("id") % 2).cast("int").alias("g"), F.floor(F.col("id") / 2).cast("int").alias("c"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: r["planes"] for r in windows.planes(d, ["g"], F.col("c"), [F.col("v"), F.lit(1)], 25_000).collect()}
    assert got[1][:3] == [1.0, 3.0, 5.0] and len(got[0]) == 50_000 and set(got[0][25_000:]) == {1.0}


def test_forecast_run_checks_its_arguments(spark, tmp_path):
    d = small_cube(spark).drop("it").withColumn("LAI_flag", F.lit(1.0))
    w = forecast.random_weights(2, 2)
    with pytest.raises(ValueError, match="go together"):
        forecast.run_forecast(d, w, forecast.Inference(3, 2, first_lead=1))
    with pytest.raises(ValueError, match="not within"):
        forecast.run_forecast(d, w, forecast.Inference(3, 2, first_lead=1, last_lead=3))
    with pytest.raises(ValueError, match="empty"):
        forecast.run_forecast(d.limit(0), w, forecast.Inference(3, 2))
    f, _ = forecast.run_forecast(d, w, forecast.Inference(3, 2, first_lead=2, last_lead=2, tail="drop", half=False))
    assert {r[0] for r in f.select("lead").distinct().collect()} == {2} and f.count() == 4 * 16
    path = str(tmp_path / "f")
    part = d.filter(F.col("time") < DAY + dt.timedelta(days=6))
    assert forecast.run_forecast(part, w, forecast.Inference(3, 2), output=path)[1] == 0
    g, before = forecast.run_forecast(d, w, forecast.Inference(3, 2), output=path, append=True)
    assert before == 4 and g.groupBy("init_date", "lead", "iy", "ix").count().filter("count > 1").isEmpty() and g.select("init_date").distinct().count() == 6
    with pytest.raises(Exception, match="already exists"):
        forecast.run_forecast(d, w, forecast.Inference(3, 2), output=path)
