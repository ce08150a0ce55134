"""Queries that write to the shared folder and read back, each with SQL for what must come back."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridspark.operators import align, features, forecast, metrics, windows
from gridspark.operators.grid import mesh
from gridspark.plans.reference import _FC, _LAI, _NORMS, _OBS, _WEATHER, KM100, _grid_sql, _indexed, _lai_steps, _r, _weather_features, grid, lai_cube, observations, query, table, weather_cube
from gridspark.session import new_path
from gridspark.sources import cube as store
from gridspark.sources import stations as st
from gridspark.streaming.daily import grow_cube, read_arrivals, windowed_totals

SPLIT = "2022-01-01"
_CUBE = "time, iy, ix, round(CAST(tmax AS FLOAT), 3) AS tmax, round(CAST(prcp AS FLOAT), 3) AS prcp"


def _values(df):
    return df.select("time", "iy", "ix", *_r("tmax", "prcp", digits=3))


@query(f"WITH {_WEATHER} SELECT {_CUBE} FROM cube WHERE time BETWEEN DATE '2021-11-15' AND DATE '2022-03-31'")
def snk02_src06_cube_round_trip(spark, d):
    path = new_path(spark, "cube")
    store.create_cube(weather_cube(spark, d), path)
    store.create_cube(weather_cube(spark, d), path, overwrite=True)
    return _values(store.scan_cube(spark, path, "2021-11-15", "2022-03-31", ["tmax", "prcp"]))


@query(f"WITH {_WEATHER} SELECT {_CUBE} FROM cube")
def snk03_append_round_trip(spark, d):
    """Half of the cube, then all of it, twice: every step is there once."""
    path, c = new_path(spark, "cube"), weather_cube(spark, d)
    store.append_cube(c.filter(F.col("time") < SPLIT), path)
    for _ in range(2):
        store.append_cube(c, path)
    return _values(store.scan_cube(spark, path))


@query(f"WITH {_WEATHER} SELECT 'refused' AS result, count(*) AS rows FROM cube WHERE time < DATE '{SPLIT}'")
def snk05_refuses_to_overwrite(spark, d):
    path, c = new_path(spark, "cube"), weather_cube(spark, d)
    store.create_cube(c.filter(F.col("time") < SPLIT), path)
    result = "written"
    try:
        store.create_cube(c, path)
    except AnalysisException:
        result = "refused"
    return store.scan_cube(spark, path).agg(F.lit(result).alias("result"), F.count("*").alias("rows"))


@query(f"WITH {_WEATHER} SELECT time, iy, ix, round(tmax, 3) AS tmax, CASE WHEN prcp > 1 THEN 1 WHEN prcp IS NOT NULL THEN 0 END AS wet FROM cube")
def snk06_replaced_variable(spark, d):
    """A group of variables is added to a cube, then replaced; the other group is never rewritten."""
    root, c = new_path(spark, "variables"), weather_cube(spark, d)
    store.put_variables(c.select("time", "iy", "ix", "tmax"), root, "weather")
    for limit in (0, 1):
        store.put_variables(c.select("time", "iy", "ix", (F.col("prcp") > limit).cast("int").alias("wet")), root, "flags")
    return store.open_variables(spark, root, ["weather", "flags"]).select("time", "iy", "ix", *_r("tmax", digits=3), "wet")


@query(f"WITH {_WEATHER} SELECT {_CUBE} FROM cube")
def snk07_tiled_layout(spark, d):
    path = new_path(spark, "cube")
    store.create_cube(weather_cube(spark, d), path, tile=16)
    return _values(store.scan_cube(spark, path))


@query(f"WITH {_OBS} SELECT element, CAST(year(date) AS INT) AS year, count(*) AS n, round(sum(value), 3) AS total FROM obs GROUP BY 1, 2")
def snk01_variable_year_files(spark, d):
    path = new_path(spark, "observations")
    store.write_by_variable_year(observations(spark, d), path)
    back = spark.read.schema("station_id string, date date, value double, element string, year int").option("header", True).csv(path)
    return back.groupBy("element", "year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"WITH {_OBS} SELECT element, count(*) AS rows, count(DISTINCT station_id) AS stations FROM obs WHERE station_id IN (SELECT station_id FROM stations WHERE elev BETWEEN 0 AND 500) GROUP BY element")
def src03_snk10_station_id_file(spark, d):
    path = new_path(spark, "ids")
    store.write_station_ids(table(spark, d, "stations").filter(F.col("elev").between(0, 500)), path)
    o = st.typed_observations(table(spark, d, "obs_by_year"), st.scan_station_ids(spark, path))
    return st.observation_counts(o.groupBy("station_id", "date", "element").agg(F.max("value").alias("value")))


@query(f"WITH {_OBS} SELECT station_id, date, round(value, 3) AS tmin FROM obs WHERE element = 'TMIN'")
def src04_variable_files(spark, d):
    """One of the two files is missing and skipped."""
    path = new_path(spark, "tmin")
    st.extract_variable(observations(spark, d), "TMIN").write.option("header", True).csv(path)
    return st.scan_variable(spark, [path, path + "-missing"], "tmin").select("station_id", "date", *_r("tmin", digits=3))


@query(_grid_sql().replace("SELECT a.i AS iy, b.i AS ix", "SELECT CAST(a.i AS INT) AS iy, CAST(b.i AS INT) AS ix"))
def src07_src08_stored_grid(spark, d):
    """A grid definition written, read back, its axes meshed, and found again from the mesh."""
    path = new_path(spark, "grid")
    store.write_grid(spark, grid(KM100), path)
    cells = store.read_grid(spark, path).cells(spark)
    both = mesh(cells.select("iy", "y").distinct(), cells.select("ix", "x").distinct())
    return store.grid_of(both).cells(spark)


@query(f"""WITH {_NORMS}, s AS (SELECT avg(CASE WHEN temp_flag <> prcp_flag THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) FILTER (temp_flag = 1 AND prcp_flag =
    1) AS n_both, count(*) FILTER (temp_flag = 1) AS n_temp FROM f)
  SELECT 'temp_flag, prcp_flag' AS flags, share < 0.05 AS combined, CASE WHEN share < 0.05 THEN n_both END AS n FROM s UNION ALL SELECT
    'temp_flag, temp_flag', true, n_temp FROM s""")
def scl08_flag_decision(spark, d):
    """Two flags become one only where they differ on less than 5 % of the rows."""
    f, parts = _weather_features(spark, d), []
    for a, b in (("temp_flag", "prcp_flag"), ("temp_flag", "temp_flag")):
        g = features.combine_flags(f, a, b)
        done = "weather_flag" in g.columns
        parts.append(g.agg(F.lit(f"{a}, {b}").alias("flags"), F.lit(done).alias("combined"), (F.sum(F.col("weather_flag").cast("long")) if done else F.lit(None).cast("long")).alias("n")))
    return parts[0].unionByName(parts[1])


@query(f"WITH {_WEATHER} SELECT time, iy AS lat, ix AS lon, round(tmax, 3) AS tmax FROM cube")
def flt10_flt12_renamed_dimensions(spark, d):
    c = weather_cube(spark, d).withColumnsRenamed({"iy": "y", "ix": "x"})
    return align.rename_dimensions(align.drop_variables(c, ["tmin", "prcp", "not there"])).withColumn("tmax", F.round("tmax", 3))


# --- streams ------------------------------------------------------------------------------------------------------

@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS "start", event_type, round(sum(value), 4) AS total, round(avg(value), 9) AS mean, count(value) AS n
    FROM events GROUP BY 1, 2""")
def stream02_totals_of_arriving_files(spark, d):
    """Windowed totals by a streaming query over files as they arrive, its last state read back."""
    files, out = new_path(spark, "arrivals"), new_path(spark, "totals")
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartition(3).write.parquet(files)
    w = windowed_totals(read_arrivals(spark, files, "ts timestamp, event_type string, value double", 1), "ts", ["event_type"], "value", late="10000 days")
    save = lambda batch, n: batch.write.mode("overwrite").parquet(out)
    w.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    w = spark.read.parquet(out)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("total", 4).alias("total"), F.round("mean", 9).alias("mean"), "n")


@query(f"WITH {_WEATHER} SELECT {_CUBE} FROM cube")
def stream03_growing_cube(spark, d):
    """Cells arrive in three files, days split between them and some cells twice; the stored cube holds each once."""
    files, path = new_path(spark, "arrivals"), new_path(spark, "cube")
    c = weather_cube(spark, d)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
    c.unionByName(c.filter("iy % 3 = 0")).repartition(3, "iy", "ix").write.parquet(files)
    grow_cube(read_arrivals(spark, files, kind, 1), path, new_path(spark, "state")).awaitTermination()
    return _values(store.scan_cube(spark, path))


# --- forecasts ----------------------------------------------------------------------------------------------------

@query(f"""WITH {_FC}, fc AS (SELECT time AS init_date, it, 0 AS lead, iy, ix, LAI_norm FROM c WHERE it >= 3
  UNION ALL SELECT time, it, lead, iy, ix, CASE WHEN it + 5 <= last THEN LAI_norm ELSE 0 END FROM c, l, lead WHERE it >= 3)
  SELECT init_date, lead, iy, ix, round(LAI_norm, 6) + 0 AS LAI_norm, (SELECT count(DISTINCT init_date) FROM fc WHERE init_date < DATE '{SPLIT}') AS
    before FROM fc""")
def fc04_appended_period(spark, d):
    c = _lai_steps(spark, d)
    f = forecast.forecast_cube(c, forecast.persistence(c, 4, 5), 4, 5)
    both, offset = forecast.append_period(f.filter(F.col("init_date") < SPLIT), f)
    return both.select("init_date", "lead", "iy", "ix", *_r("LAI_norm"), F.lit(offset).cast("long").alias("before"))


def _calendar_network(hidden: int = 2, two_layers: bool = False) -> dict[str, np.ndarray]:
    """A network whose recurrent part is silent: it forecasts 0.5 + sine + cosine / 4 of the day of year."""
    w = {n: np.zeros_like(a) for n, a in forecast.random_weights(2, hidden, two_layers=two_layers).items()}
    w["fc.weight"][0, hidden:, 0, 0], w["fc.bias"][0] = (1.0, 0.25), 0.5
    return w


def _half_sql(v: str) -> str:
    """``v`` rounded to half precision: eleven significant bits, ties to even."""
    unit = f"pow(2.0::DOUBLE, greatest(floor(log2(abs(nullif({v}, 0)))), -14) - 10)"
    return f"coalesce(round_even({v} / {unit}, 0) * {unit}, {v})"


_DOY = "0.5 + sin(2 * pi() * dayofyear(t.time) / 365) + 0.25 * cos(2 * pi() * dayofyear(t.time) / 365)"


@query(f"""WITH {_LAI}, st AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS it FROM (SELECT DISTINCT time FROM lai)), c AS (SELECT lai.*, it FROM lai
    JOIN st USING (time)), l AS (SELECT max(it) AS last FROM st),
  fc AS (SELECT c.time AS init_date, 0 AS lead, iy, ix, LAI_norm AS v FROM c WHERE it >= 2
  UNION ALL SELECT c.time, k.lead, iy, ix, CASE WHEN c.it + 2 <= last THEN {_DOY} ELSE 0 END FROM c, l, (SELECT unnest([1, 2]) AS lead) k LEFT JOIN st
    t ON t.it = c.it + k.lead WHERE c.it >= 2)
  SELECT init_date, CAST(lead AS INT) AS lead, iy, ix, {_half_sql('v')} + 0 AS LAI_norm FROM fc""")
def fc07_ml03_forecast_run(spark, d):
    """The whole run: weights from a table, flags replaced, ConvLSTM over the area, cube written in two goes and read."""
    c, path = lai_cube(spark, d).withColumn("LAI_flag", F.col("LAI_flag").cast("double")), new_path(spark, "forecast")
    w = forecast.load_weights(forecast.save_weights(spark, _calendar_network()))
    flags = c.select("time", "iy", "ix", F.lit(1.0).alias("LAI_flag"))
    run = forecast.Inference(3, 2)
    for _ in range(2):
        f, _before = forecast.run_forecast(c, w, run, flags, output=path, append=True)
    return f.select("init_date", "lead", "iy", "ix", (F.col("LAI_norm").cast("double") + F.lit(0.0)).alias("LAI_norm"))


def _cell_sql(w: dict, name: str, x: str, h: str, c: str) -> tuple[str, str]:
    """(hidden, cell) state of a one-cell, one-channel LSTM step as SQL."""
    k, b = w[f"{name}.conv.weight"][:, :, 0, 0], w[f"{name}.conv.bias"]
    gate = lambda g: f"({float(k[g, 0])!r}::DOUBLE * {x} + {float(k[g, 1])!r}::DOUBLE * {h} + {float(b[g])!r}::DOUBLE)"
    s = lambda v: f"(1 / (1 + exp(-{v})))"
    t = lambda v: f"((exp(2 * {v}) - 1) / (exp(2 * {v}) + 1))"
    cell = f"({s(gate(1))} * {c} + {s(gate(0))} * {t(gate(3))})"
    return f"{s(gate(2))} * {t(cell)}", cell


def _pixel_network(two: bool) -> dict[str, np.ndarray]:
    return forecast.random_weights(1, 1, kernel=1, two_layers=two, doy=False, seed=5)


def _pixel_sql(two: bool) -> str:
    """Two inputs, one output, step by step in nested selects; kernel 1, so every cell stands alone."""
    w = _pixel_network(two)
    layers = ("_1", "_2") if two else ("",)
    state = "".join(f", 0.0::DOUBLE AS h{n}, 0.0::DOUBLE AS c{n}" for n in range(len(layers)))
    sql = f"SELECT seq, iy, ix, x0, x1{state} FROM w"
    for side, x in (("encoder", "x0"), ("encoder", "x1"), ("decoder", "0.0::DOUBLE")):
        for n, layer in enumerate(layers):
            h, c = _cell_sql(w, side + layer, x if n == 0 else f"h{n - 1}", f"h{n}", f"c{n}")
            sql = f"SELECT * REPLACE (({h}) AS h{n}, ({c}) AS c{n}) FROM ({sql})"
    return f"SELECT CAST(seq AS INT) AS seq, 1 AS lead, iy, ix, '{'stacked' if two else 'single'}' AS network, round({float(w['fc.weight'][0, 0, 0, 0])!r}::DOUBLE * h{len(layers) - 1} + {float(w['fc.bias'][0])!r}::DOUBLE, 6) AS pred FROM ({sql})"


@query(f"""WITH {_LAI}, st AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS it FROM (SELECT DISTINCT time FROM lai)), c AS (SELECT iy, ix, it,
    CAST(LAI_norm AS FLOAT)::DOUBLE AS v FROM lai JOIN st USING (time)),
  area AS (SELECT a.i AS iy, b.i AS ix FROM (SELECT CAST(unnest(generate_series(0, (SELECT max(iy) FROM c))) AS INT) AS i) a, (SELECT
    CAST(unnest(generate_series(0, (SELECT max(ix) FROM c))) AS INT) AS i) b),
  w AS (SELECT s.it AS seq, area.iy, area.ix, coalesce(c0.v, 0) AS x0, coalesce(c1.v, 0) AS x1 FROM st s CROSS JOIN area LEFT JOIN c c0 ON c0.it =
    s.it AND c0.iy = area.iy AND c0.ix = area.ix
        LEFT JOIN c c1 ON c1.it = s.it + 1 AND c1.iy = area.iy AND c1.ix = area.ix WHERE s.it + 2 <= (SELECT max(it) FROM st))
  {_pixel_sql(False)} UNION ALL {_pixel_sql(True)}""")
def ml01_ml02_ml04_scl15_pixel_networks(spark, d):
    """The plain and the stacked network with kernels of one cell, over every window and cell of the area."""
    c = _lai_steps(spark, d)
    r = c.agg(F.max("it"), F.max("iy"), F.max("ix")).first()
    spec = windows.WindowSpec(r[0] + 1, r[1] + 1, r[2] + 1, 2, 1)
    both = [forecast.predict(c, spec, ["LAI_norm"], _pixel_network(two), doy=False).withColumn("network", F.lit("stacked" if two else "single")) for two in (False, True)]
    return both[0].unionByName(both[1]).select("seq", "lead", "iy", "ix", "network", *_r("pred"))


@query(f"""WITH {_NORMS}, st AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS it FROM (SELECT DISTINCT time FROM cube)), n AS (SELECT floor((max(iy) +
    1) / 3) AS py, floor((max(ix) + 1) / 3) AS px FROM cube),
  k AS (SELECT CAST(floor(5 / (py * px)) AS INT) AS seq, CAST(5 % py AS INT) AS lat_patch, CAST(floor((5 % (py * px)) / py) AS INT) AS lon_patch FROM
    n WHERE py * px > 0)
  SELECT CASE WHEN it - seq * 14 < 14 THEN 'x' ELSE 'y' END AS role, time, iy, ix, round(tmax_norm, 6) AS tmax_norm FROM f JOIN st USING (time), k
  WHERE it BETWEEN seq * 14 AND seq * 14 + 27 AND floor(iy / 3) = lat_patch AND floor(ix / 3) = lon_patch""")
def ds07_sample_cells(spark, d):
    c, spec = _indexed(spark, d)
    x, y = windows.sample_cells(c, spec, 5)
    return x.withColumn("role", F.lit("x")).unionByName(y.withColumn("role", F.lit("y"))).select("role", "time", "iy", "ix", *_r("tmax_norm"))


@query("""SELECT CAST(4 * 16 * (10 + 2 + 16) * 3 * 3 + 4 * 16 + 4 * 16 * (1 + 16) * 3 * 3 + 4 * 16 + (16 + 2) + 1 AS BIGINT) AS single,
  CAST(4 * 16 * (10 + 2 + 16) * 3 * 3 + 4 * 16 + 4 * 16 * (1 + 16) * 3 * 3 + 4 * 16 + 2 * (4 * 16 * (16 + 16) * 3 * 3 + 4 * 16) + (16 + 2) + 1 AS
    BIGINT) AS stacked""")
def agg15_src10_parameter_count(spark, d):
    """Parameters of both networks, counted from weights written to a table and read back."""
    counts = []
    for two in (False, True):
        path = new_path(spark, "weights")
        forecast.save_weights(spark, forecast.random_weights(10, 16, two_layers=two)).write.parquet(path)
        w = spark.read.parquet(path)
        assert forecast.stacked(forecast.load_weights(w)) == two
        counts.append(metrics.parameter_count(w).withColumnRenamed("parameters", "stacked" if two else "single"))
    return counts[0].crossJoin(counts[1])  # one row each
