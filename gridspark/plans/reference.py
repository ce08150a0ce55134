"""Queries over the operators of the weather, vegetation and station pipeline, each over its whole tables, with SQL
written on its own beside them. The names begin with the ids of the operators they show."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import Laea, equirectangular_km
from gridspark.functions.missing import in_range
from gridspark.functions.scalar import cast_by_name, doy_encoding, log_zscore, masked_zscore, to_half, zscore
from gridspark.operators import align, features, forecast, interp, metrics, regrid, windows
from gridspark.operators.grid import Grid
from gridspark.operators.regular_grid import period_of, period_start
from gridspark.sources import stations as st
from gridspark.sources.cube import new_steps
from gridspark.streaming.daily import windowed_totals

TRAIN_END = "2022-02-28"
BOX = {"lat_min": 23.8, "lat_max": 39.2, "lon_min": -110.25, "lon_max": -90.5}
KM100, KM50 = 100_000.0, 50_000.0
LC_YEARS = ("1996-01-01", "1998-01-01", "1999-01-01")


@lru_cache
def proj() -> Laea:
    return Laea.for_box(**BOX)


@lru_cache
def grid(res: float) -> Grid:
    return Grid.for_box(**BOX, res=res)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- shared inputs --------------------------------------------------------------------------------------------

def positions(spark: SparkSession, d: str) -> DataFrame:
    """``station_id, lat, lon, elev, x, y`` (metres) of the stations that have a position."""
    s = table(spark, d, "stations")
    s = s.filter(in_range(F.col("lat"), -90, 90).isNotNull() & in_range(F.col("lon"), -180, 180).isNotNull())
    s = s.groupBy("station_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.max(in_range(F.col("elev"), -500, 9000)).alias("elev"))
    x, y = proj().forward(F.col("lat"), F.col("lon"))
    return s.withColumns({"x": x, "y": y})


def observations(spark: SparkSession, d: str, low: float = -90, high: float = 2000) -> DataFrame:
    o = st.typed_observations(table(spark, d, "obs_by_year"))
    return o.groupBy("station_id", "date", "element").agg(F.max("value").alias("value"))


def weather_cube(spark: SparkSession, d: str) -> DataFrame:
    """``time, iy, ix, tmax, tmin, prcp`` with valid values or NULL, one row per cell and day."""
    w = table(spark, d, "weather_daily")
    v = lambda c, a, b: F.max(in_range(F.col(c), a, b)).alias(c)
    return w.groupBy("time", "iy", "ix").agg(v("tmax", -90, 60), v("tmin", -90, 60), v("prcp", 0, 2000))


def lai_cube(spark: SparkSession, d: str) -> DataFrame:
    """``time, iy, ix, LAI_norm, LAI_flag`` per 4-day period: mean of the valid readings, flag 1 where there is one."""
    r = table(spark, d, "lai_readings").withColumn("time", period_start(period_of(F.col("time"))))
    ok = F.when(F.col("LAI_flag") == 1, in_range(F.col("LAI_norm"), -1e6, 1e6))
    g = r.groupBy("time", "iy", "ix").agg(F.avg(ok).alias("v"))
    return g.select("time", "iy", "ix", F.coalesce("v", F.lit(0.0)).alias("LAI_norm"), F.col("v").isNotNull().cast("int").alias("LAI_flag"))


_WEATHER = """cube AS (SELECT time, iy, ix, max(CASE WHEN isfinite(tmax) AND tmax BETWEEN -90 AND 60 THEN CAST(tmax AS DOUBLE) END) AS tmax,
  max(CASE WHEN isfinite(tmin) AND tmin BETWEEN -90 AND 60 THEN CAST(tmin AS DOUBLE) END) AS tmin, max(CASE WHEN isfinite(prcp) AND prcp BETWEEN 0 AND
    2000 THEN CAST(prcp AS DOUBLE) END) AS prcp
  FROM weather_daily GROUP BY time, iy, ix)"""
_PERIOD_START = "(make_date(year(time), 1, 1) + CAST(floor((dayofyear(time) - 1) / 4) * 4 AS INT))"
_LAI = f"""lai AS (SELECT t AS time, iy, ix, coalesce(v, 0) AS LAI_norm, CAST(v IS NOT NULL AS INT) AS LAI_flag FROM (SELECT {_PERIOD_START} AS t, iy, ix,
  avg(CASE WHEN LAI_flag = 1 AND isfinite(LAI_norm) AND LAI_norm BETWEEN -1e6 AND 1e6 THEN CAST(LAI_norm AS DOUBLE) END) AS v FROM lai_readings GROUP
    BY 1, 2, 3))"""
_OBS = """obs AS (SELECT station_id, date, element, max(CASE WHEN element IN ('TMAX', 'TMIN') THEN v / 10 ELSE v END) AS value FROM (
  SELECT station_id, CAST(try_strptime(date, '%Y%m%d') AS DATE) AS date, element, TRY_CAST(trim(value) AS DOUBLE) AS v FROM obs_by_year WHERE element
    IN ('TMAX', 'TMIN', 'PRCP'))
  WHERE date IS NOT NULL AND isfinite(v) GROUP BY 1, 2, 3)"""


def _own_projection() -> dict[str, float]:
    """Constants of the projection from the formula sheet (WGS 84, centred on the box), apart from the library's own."""
    import math

    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    lat0, lon0 = math.radians((23.8 + 39.2) / 2), math.radians((-110.25 - 90.5) / 2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp, s0 = q(1.0), math.sin(lat0)
    b0, rq = math.asin(q(s0) / qp), a * math.sqrt(qp / 2)
    return {"e2": e2, "e": e, "qp": qp, "b0": b0, "rq": rq, "d": a * math.cos(lat0) / (math.sqrt(1 - e2 * s0 * s0) * rq * math.cos(b0)), "lon0": lon0}


def _laea_sql() -> tuple[str, str]:
    """x and y of the projection as SQL over lat, lon."""
    import math

    k = _own_projection()
    num = lambda v: f"{v!r}::DOUBLE"
    s = "sin(radians(lat))"
    beta = f"asin((1 - {num(k['e2'])}) * ({s} / (1 - {num(k['e2'])} * {s} * {s}) - ln((1 - {num(k['e'])} * {s}) / (1 + {num(k['e'])} * {s})) / (2 * {num(k['e'])})) / {num(k['qp'])})"
    dl = f"(radians(lon) - {num(k['lon0'])})"
    sb, cb = num(math.sin(k["b0"])), num(math.cos(k["b0"]))
    scale = f"({num(k['rq'])} * sqrt(2 / (1 + {sb} * sin({beta}) + {cb} * cos({beta}) * cos({dl}))))"
    return f"{scale} * {num(k['d'])} * cos({beta}) * sin({dl})", f"{scale} / {num(k['d'])} * ({cb} * sin({beta}) - {sb} * cos({beta}) * cos({dl}))"


def _positions_sql() -> str:
    x, y = _laea_sql()
    return f"""sta AS (SELECT *, {x} AS x, {y} AS y FROM (SELECT station_id, min(lat) AS lat, min(lon) AS lon, max(CASE WHEN isfinite(elev) AND elev BETWEEN -500 AND
    9000 THEN elev END) AS elev
      FROM stations WHERE isfinite(lat) AND lat BETWEEN -90 AND 90 AND isfinite(lon) AND lon BETWEEN -180 AND 180 GROUP BY station_id))"""


def _bounds_sql(res: float, name: str) -> str:
    """Ends of the axes of the grid over the box: its projected corners, snapped outwards to multiples of ``res``."""
    x, y = _laea_sql()
    corners = ", ".join(f"({lat}, {lon})" for lat in (23.8, 39.2) for lon in (-110.25, -90.5))
    return f"""{name} AS (SELECT floor(min(x) / {res!r}) * {res!r} AS x0, ceil(max(x) / {res!r}) * {res!r} AS x1, floor(min(y) / {res!r}) * {res!r} AS y0,
    ceil(max(y) / {res!r}) * {res!r} AS y1
      FROM (SELECT {x} AS x, {y} AS y FROM (VALUES {corners}) t(lat, lon)))"""


def _nodes_sql(res: float, name: str = "nodes") -> str:
    return f"""{_bounds_sql(res, f'{name}_box')}, {name} AS (SELECT CAST(a.i AS INT) AS iy, CAST(b.i AS INT) AS ix, y0 + a.i * {res!r}::DOUBLE AS y, x0 + b.i *
    {res!r}::DOUBLE AS x
      FROM {name}_box, generate_series(0, 400) a(i), generate_series(0, 400) b(i) WHERE x0 + b.i * {res!r} <= x1 AND y0 + a.i * {res!r} <= y1)"""


def _cell_sql(res: float) -> str:
    return f"""{_bounds_sql(res, 'cells_box')}, cells AS (SELECT sta.*, CAST(floor((y - (y0 - {res / 2!r})) / {res!r}) AS INT) AS iy, CAST(floor((x - (x0 -
    {res / 2!r})) / {res!r}) AS INT) AS ix FROM sta, cells_box)"""


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def _rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# --- sources, filters -----------------------------------------------------------------------------------------

@query(f"WITH {_OBS} SELECT station_id, date, element, round(value, 3) AS value FROM obs")
def src01_flt02_flt14_observations(spark, d):
    return observations(spark, d).select("station_id", "date", "element", *_r("value", digits=3))


@query("""SELECT trim(substr(line, 1, 11), ' ') AS station_id, CAST(trim(substr(line, 12, 9), ' ') AS DOUBLE) AS lat, CAST(trim(substr(line, 21, 10), ' ') AS
    DOUBLE) AS lon,
  TRY_CAST(trim(substr(line, 31, 7), ' ') AS DOUBLE) AS elev, trim(substr(line, 39), ' ') AS name FROM raw_records WHERE file_name = 'stations.txt'
    AND length(line) >= 30
  AND TRY_CAST(trim(substr(line, 12, 9), ' ') AS DOUBLE) IS NOT NULL AND TRY_CAST(trim(substr(line, 21, 10), ' ') AS DOUBLE) IS NOT NULL
  AND (trim(substr(line, 31, 7), ' ') = '' OR TRY_CAST(trim(substr(line, 31, 7), ' ') AS DOUBLE) IS NOT NULL)""")
def src02_scl16_station_lines(spark, d):
    return st.parse_stations(table(spark, d, "raw_records").filter("file_name = 'stations.txt'"), "line")


@query(f"WITH {_OBS} SELECT element, count(*) AS rows, count(DISTINCT station_id) AS stations FROM obs WHERE station_id IN (SELECT station_id FROM stations WHERE elev BETWEEN 0 AND 9000) GROUP BY element")
def flt01_src03_agg07_station_extract(spark, d):
    ids = table(spark, d, "stations").filter(F.col("elev").between(0, 9000)).select("station_id").distinct()
    o = st.typed_observations(table(spark, d, "obs_by_year"), ids)
    return st.observation_counts(o.groupBy("station_id", "date", "element").agg(F.max("value").alias("value")))


@query("""SELECT DISTINCT station_id, lat, lon, lat BETWEEN 25.8 AND 37.2 AND lon BETWEEN -108.25 AND -92.5 AS in_target FROM stations
  WHERE lat BETWEEN 23.8 AND 39.2 AND lon BETWEEN -110.25 AND -90.5""")
def flt03_snk11_bounding_box(spark, d):
    return st.in_box(table(spark, d, "stations"), **st.TARGET_BOX).select("station_id", "lat", "lon", "in_target").distinct()


@query(f"""SELECT l_linestatus, count(*) AS n, count(CASE WHEN qc NOT IN {regrid.QC_CLOUDY} AND ex IN {regrid.QC_LAND} THEN 1 END) AS kept,
  round(sum(CASE WHEN qc NOT IN {regrid.QC_CLOUDY} AND ex IN {regrid.QC_LAND} THEN l_quantity END), 3) AS total
  FROM (SELECT *, l_partkey % 128 AS qc, l_orderkey % 256 AS ex FROM lineitem) GROUP BY l_linestatus""")
def flt04_qc_mask(spark, d):
    v = regrid.qc_mask(F.col("l_quantity"), F.col("l_partkey") % 128, F.col("l_orderkey") % 256)
    return table(spark, d, "lineitem").withColumn("v", v).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count("v").alias("kept"), F.round(F.sum("v"), 3).alias("total"))


@query(f"""WITH {_WEATHER} SELECT 'train' AS part, count(*) AS n, min(time) AS first, max(time) AS last FROM cube WHERE time <= DATE '2022-02-28' AND time >=
    DATE '2021-10-05'
  UNION ALL SELECT 'val', count(*), min(time), max(time) FROM cube WHERE time >= DATE '2022-03-01'""")
def flt06_flt07_time_split(spark, d):
    train, val = features.split_by_time(features.time_range(weather_cube(spark, d), "2021-10-05"), "2022-03-01")
    one = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    return one(train, "train").union(one(val, "val"))


@query("SELECT time, iy, ix, CAST(temp_flag AS INT) AS temp_flag, round(tmax, 2) AS tmax FROM (SELECT DISTINCT time, iy, ix, temp_flag, CAST(tmax AS FLOAT) AS tmax FROM weather_daily WHERE temp_flag BETWEEN -1 AND 1 AND isfinite(tmax))")
def flt05_flt11_cast_by_name(spark, d):
    w = align.select_variables(table(spark, d, "weather_daily"), ["temp_flag", "tmax", "temp_flag"]).filter(F.col("temp_flag").between(-1, 1) & in_range(F.col("tmax"), -1e30, 1e30).isNotNull())
    return cast_by_name(w).distinct().select("time", "iy", "ix", F.col("temp_flag").cast("int").alias("temp_flag"), *_r("tmax", digits=2))


@query(f"""WITH {_WEATHER}, f AS (SELECT time, iy, ix, CAST(prcp IS NOT NULL AS INT) AS flag FROM cube)
  SELECT c.time, c.iy, c.ix, round(c.tmax, 3) AS tmax, f.flag AS prcp FROM cube c JOIN f USING (time, iy, ix)""")
def flt13_fc06_replace_variable(spark, d):
    c = weather_cube(spark, d)
    other = c.select("time", "iy", "ix", F.col("prcp").isNotNull().cast("int").alias("prcp"))
    return align.replace_variable(c.select("time", "iy", "ix", "tmax", "prcp"), other, "prcp").select("time", "iy", "ix", *_r("tmax", digits=3), "prcp")


# --- joins, regridding, interpolation ---------------------------------------------------------------------------

@query(f"WITH {_OBS}, {_positions_sql()} SELECT element, count(*) AS n, count(DISTINCT station_id) AS stations, round(avg(lat), 6) AS lat FROM obs JOIN sta USING (station_id) GROUP BY element")
def join01_observations_with_stations(spark, d):
    j = st.with_stations(observations(spark, d), positions(spark, d))
    return j.groupBy("element").agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("stations"), F.round(F.avg("lat"), 6).alias("lat"))


@query(f"""WITH {_positions_sql()}, {_nodes_sql(KM100)} SELECT iy, ix, count(*) AS n, round(min(sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2)), 3) AS nearest
  FROM nodes n JOIN sta s ON (n.x - s.x) ** 2 + (n.y - s.y) ** 2 <= 150000.0::DOUBLE ** 2 GROUP BY iy, ix""")
def join02_scl11_radius_join(spark, d):
    n = interp.neighbours(grid(KM100).cells(spark), positions(spark, d), 150_000.0)
    return n.groupBy("iy", "ix").agg(F.count("*").alias("n"), F.round(F.sqrt(F.min("d2")), 3).alias("nearest"))


@query(f"WITH {_positions_sql()} SELECT a.station_id, count(*) AS n FROM sta a JOIN sta b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 20000.0::DOUBLE ** 2 GROUP BY 1")
def join03_radius_self_join(spark, d):
    s = positions(spark, d).select("station_id", "x", "y")
    return interp.radius_join(s, s.withColumnRenamed("station_id", "other"), 20_000.0).groupBy("station_id").agg(F.count("*").alias("n"))


_SPACING_SQL = f"""WITH {_positions_sql()}, m AS (SELECT cos(radians(avg(lat))) * 111 AS k FROM sta), p AS (SELECT station_id, lon * k AS x, lat * 111.0::DOUBLE AS y
    FROM sta, m),
  sp AS (SELECT a.station_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS spacing FROM p a JOIN p b ON a.station_id <> b.station_id GROUP BY 1)"""


def _spacing(spark: SparkSession, d: str) -> DataFrame:
    s = positions(spark, d)
    mean = s.agg(F.avg("lat")).first()[0]
    x, y = equirectangular_km(F.col("lat"), F.col("lon"), mean or 0.0)
    return interp.nearest_spacing(s.select("station_id", x.alias("x"), y.alias("y")), "station_id", "x", "y")


@query(_SPACING_SQL + " SELECT station_id, round(spacing, 6) AS spacing FROM sp")
def join04_scl12_nearest_spacing(spark, d):
    return _spacing(spark, d).select("station_id", *_r("spacing"))


@query(_SPACING_SQL + """ SELECT count(*) AS n, round(avg(spacing), 6) AS mean, round(stddev_pop(spacing), 6) AS std, round(quantile_cont(spacing, 0.1), 6) AS p10, round(quantile_cont(spacing, 0.25), 6) AS p25,
  round(quantile_cont(spacing, 0.5), 6) AS median, round(quantile_cont(spacing, 0.75), 6) AS p75, round(quantile_cont(spacing, 0.9), 6) AS p90, round(max(spacing), 6) AS max,
  round((1.33 * quantile_cont(spacing, 0.5)) ** 2 / 4, 6) AS kappa FROM sp""")
def agg06_int12_spacing_summary(spark, d):
    s = interp.spacing_summary(_spacing(spark, d)).withColumn("kappa", F.pow(F.lit(1.33) * F.col("median"), 2) / 4)
    return s.select("n", *_r("mean", "std", "p10", "p25", "median", "p75", "p90", "max", "kappa"))


@query(f"WITH {_positions_sql()}, {_cell_sql(KM100)}, {_nodes_sql(KM100)} SELECT n.iy, n.ix, round(avg(c.elev), 6) AS elev FROM nodes n LEFT JOIN cells c ON c.iy = n.iy AND c.ix = n.ix GROUP BY n.iy, n.ix")
def agg01_join05_bucket_mean(spark, d):
    g = grid(KM100)
    iy, ix = g.key(F.col("x"), F.col("y"))
    s = positions(spark, d).withColumns({"iy": iy, "ix": ix})
    return regrid.bucket_mean(s, ["iy", "ix"], "elev", g.cells(spark).select("iy", "ix")).select("iy", "ix", *_r("elev"))


@query(f"""WITH {_positions_sql()}, {_cell_sql(KM100)}, {_nodes_sql(KM100)}, k AS (SELECT iy, ix, CAST(floor(elev / 200) AS INT) AS cls, count(*) AS c FROM cells
    WHERE elev IS NOT NULL GROUP BY 1, 2, 3),
  b AS (SELECT iy, ix, cls, row_number() OVER (PARTITION BY iy, ix ORDER BY c DESC, cls) AS r FROM k) SELECT n.iy, n.ix, b.cls FROM nodes n LEFT JOIN
    b ON b.iy = n.iy AND b.ix = n.ix AND b.r = 1""")
def agg02_bucket_mode(spark, d):
    g = grid(KM100)
    iy, ix = g.key(F.col("x"), F.col("y"))
    s = positions(spark, d).withColumns({"iy": iy, "ix": ix, "cls": F.floor(F.col("elev") / 200).cast("int")})
    return regrid.bucket_mode(s, ["iy", "ix"], "cls", g.cells(spark).select("iy", "ix"))


#: the stations of the smallest data lie some 200 km apart
_K, _RADIUS_KM = interp.kappa(200.0, 0.5), 600.0
_KM = "x / 1000 AS x, y / 1000 AS y"
_BARNES_HEAD = f"""WITH {_OBS}, {_positions_sql()}, {_nodes_sql(KM100, 'nm')}, s AS (SELECT station_id, {_KM} FROM sta), nodes AS (SELECT iy, ix, {_KM} FROM nm),
  o AS (SELECT date, station_id, value AS v FROM obs WHERE element = 'TMAX' AND value BETWEEN -90 AND 60),
  nb AS (SELECT iy, ix, station_id, (n.x - s.x) ** 2 + (n.y - s.y) ** 2 AS d2 FROM nodes n JOIN s ON (n.x - s.x) ** 2 + (n.y - s.y) ** 2 <=
    {_RADIUS_KM ** 2})"""


def _tmax(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).filter((F.col("element") == "TMAX") & F.col("value").between(-90, 60)).select("date", "station_id", "value")


def _km(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("x") / 1000, "y": F.col("y") / 1000})


@query(_BARNES_HEAD + f""" SELECT date, iy, ix, round(sum(exp(-d2 / {_K!r}::DOUBLE) * v) / sum(exp(-d2 / {_K!r}::DOUBLE)), 5) AS value FROM nb JOIN o USING (station_id) GROUP
    BY 1, 2, 3 HAVING count(*) >= 3""")
def int01_int04_int13_barnes_first_pass(spark, d):
    b = interp.barnes(_tmax(spark, d), _km(positions(spark, d)), _km(grid(KM100).cells(spark)), _RADIUS_KM, _K, passes=1)
    return b.select("date", "iy", "ix", *_r("value", digits=5))


@query(_BARNES_HEAD + f""", pr AS (SELECT a.station_id AS s1, b.station_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM s a JOIN s b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2
    <= {_RADIUS_KM ** 2}),
  gs AS (SELECT date, s1 AS station_id, sum(exp(-d2 / {_K!r}::DOUBLE) * v) / sum(exp(-d2 / {_K!r}::DOUBLE)) AS g FROM pr JOIN o USING (station_id)
    GROUP BY 1, 2),
  r AS (SELECT date, station_id, v, coalesce(v - g, 0) AS r FROM o LEFT JOIN gs USING (date, station_id))
  SELECT date, iy, ix, round(sum(exp(-d2 / {_K!r}::DOUBLE) * v) / sum(exp(-d2 / {_K!r}::DOUBLE)) + coalesce(sum(exp(-d2 / {0.3 * _K!r}::DOUBLE) * r) /
    nullif(sum(exp(-d2 / {0.3 * _K!r}::DOUBLE)), 0), 0), 5) AS value
  FROM nb JOIN r USING (station_id) GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def int02_int03_barnes_two_passes(spark, d):
    b = interp.barnes(_tmax(spark, d), _km(positions(spark, d)), _km(grid(KM100).cells(spark)), _RADIUS_KM, _K)
    return b.select("date", "iy", "ix", *_r("value", digits=5))


@query(f"""WITH {_OBS}, {_positions_sql()}, {_nodes_sql(KM100, 'nm')}, s AS (SELECT station_id, {_KM} FROM sta), nodes AS (SELECT iy, ix, {_KM} FROM nm),
  o AS (SELECT date, station_id, ln(1 + value) AS lv FROM obs WHERE element = 'PRCP' AND value >= 0 AND value < 20000),
  g AS (SELECT date, iy, ix, count(*) AS n, min_by(CASE WHEN d2 = 0 THEN lv END, CASE WHEN d2 = 0 THEN station_id END) AS hit, sum(lv / nullif(d2, 0))
    / nullif(sum(1 / nullif(d2, 0)), 0) AS m
        FROM (SELECT iy, ix, station_id, (n.x - s.x) ** 2 + (n.y - s.y) ** 2 AS d2 FROM nodes n JOIN s ON (n.x - s.x) ** 2 + (n.y - s.y) ** 2 <=
    {_RADIUS_KM ** 2}) JOIN o USING (station_id) GROUP BY 1, 2, 3)
  SELECT date, iy, ix, round(CASE WHEN exp(coalesce(hit, m)) - 1 < 0.1 THEN 0 ELSE exp(coalesce(hit, m)) - 1 END, 4) AS value FROM g WHERE n >= 3""")
def int05_idw_log(spark, d):
    o = observations(spark, d).filter((F.col("element") == "PRCP") & (F.col("value") < 20000)).select("date", "station_id", "value")
    return interp.idw_log(o, _km(positions(spark, d)), _km(grid(KM100).cells(spark)), radius=_RADIUS_KM).select("date", "iy", "ix", *_r("value", digits=4))


# --- the surveyed grids and radii: 20 km and 150 km for Barnes, 10 km and 50 km for inverse distance

_KM20, _KM10 = 20_000.0, 10_000.0
_K20 = repr((1.33 * 19.0) ** 2 / (4 * 0.5)) + "::DOUBLE"
_NEAR = "JOIN s ON s.x BETWEEN n.x - {r} AND n.x + {r} AND (n.x - s.x) ** 2 + (n.y - s.y) ** 2 <= {r} ** 2"


@query(f"""WITH {_OBS}, {_positions_sql()}, {_nodes_sql(_KM20, 'nm')}, o AS (SELECT date, station_id, value AS v FROM obs WHERE element = 'TMAX' AND value
    BETWEEN -90 AND 60),
  s AS (SELECT station_id, {_KM} FROM sta WHERE station_id IN (SELECT station_id FROM o)), nodes AS (SELECT iy, ix, {_KM} FROM nm),
  nb AS (SELECT iy, ix, station_id, (n.x - s.x) ** 2 + (n.y - s.y) ** 2 AS d2 FROM nodes n {_NEAR.format(r='150.0::DOUBLE')}),
  pr AS (SELECT n.station_id AS s1, s.station_id, (n.x - s.x) ** 2 + (n.y - s.y) ** 2 AS d2 FROM s n {_NEAR.format(r='150.0::DOUBLE')}),
  gs AS (SELECT date, s1 AS station_id, sum(exp(-d2 / {_K20}) * v) / sum(exp(-d2 / {_K20})) AS g FROM pr JOIN o USING (station_id) GROUP BY 1, 2),
  r AS (SELECT date, station_id, v, coalesce(v - g, 0) AS r FROM o LEFT JOIN gs USING (date, station_id))
  SELECT date, iy, ix, round(sum(exp(-d2 / {_K20}) * v) / sum(exp(-d2 / {_K20})) + coalesce(sum(exp(-d2 / (0.3 * {_K20})) * r) / nullif(sum(exp(-d2 /
    (0.3 * {_K20}))), 0), 0), 5) AS value
  FROM nb JOIN r USING (station_id) GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def int02_barnes_20km(spark, d):
    b = interp.barnes(_tmax(spark, d), _km(positions(spark, d)), _km(grid(_KM20).cells(spark)))
    return b.select("date", "iy", "ix", *_r("value", digits=5))


@query(f"""WITH {_OBS}, {_positions_sql()}, {_nodes_sql(_KM10, 'nm')}, o AS (SELECT date, station_id, ln(1 + value) AS lv FROM obs WHERE element = 'PRCP' AND
    value >= 0 AND value < 20000),
  s AS (SELECT station_id, {_KM} FROM sta WHERE station_id IN (SELECT station_id FROM o)), nodes AS (SELECT iy, ix, {_KM} FROM nm),
  g AS (SELECT date, iy, ix, count(*) AS n, min_by(CASE WHEN d2 = 0 THEN lv END, CASE WHEN d2 = 0 THEN station_id END) AS hit, sum(lv / nullif(d2, 0))
    / nullif(sum(1 / nullif(d2, 0)), 0) AS m
        FROM (SELECT iy, ix, station_id, (n.x - s.x) ** 2 + (n.y - s.y) ** 2 AS d2 FROM nodes n {_NEAR.format(r='50.0::DOUBLE')}) JOIN o USING
    (station_id) GROUP BY 1, 2, 3)
  SELECT date, iy, ix, round(CASE WHEN exp(coalesce(hit, m)) - 1 < 0.1 THEN 0 ELSE exp(coalesce(hit, m)) - 1 END, 4) AS value FROM g WHERE n >= 3""")
def int05_idw_10km(spark, d):
    o = observations(spark, d).filter((F.col("element") == "PRCP") & (F.col("value") < 20000)).select("date", "station_id", "value")
    return interp.idw_log(o, _km(positions(spark, d)), _km(grid(_KM10).cells(spark))).select("date", "iy", "ix", *_r("value", digits=4))


_C = grid(KM50).coarse(4 * KM50)


@query(f"""WITH {_positions_sql()}, {_nodes_sql(KM50, 'fine')}, c AS (SELECT CAST(floor((y - (y0 - 100000)) / 200000) AS INT) AS cy, CAST(floor((x - (x0 -
    100000)) / 200000) AS INT) AS cx, avg(elev) AS v FROM sta, fine_box GROUP BY 1, 2),
  k AS (SELECT x0, y0, greatest(1, ceil((x1 - x0 + 100000) / 200000)) AS nx, greatest(1, ceil((y1 - y0 + 100000) / 200000)) AS ny FROM fine_box),
  f AS (SELECT iy, ix, (x - x0) / 200000 AS tx, (y - y0) / 200000 AS ty, nx, ny FROM fine, k),
  g AS (SELECT iy, ix, least(floor(tx), nx - 2) AS i, least(floor(ty), ny - 2) AS j, tx, ty FROM f WHERE tx BETWEEN 0 AND nx - 1 AND ty BETWEEN 0 AND
    ny - 1)
  SELECT g.iy, g.ix, round((1 - (ty - j)) * (1 - (tx - i)) * a.v + (1 - (ty - j)) * (tx - i) * b.v + (ty - j) * (1 - (tx - i)) * e.v + (ty - j) * (tx
    - i) * h.v, 8) AS value FROM g
  LEFT JOIN c a ON a.cy = j AND a.cx = i LEFT JOIN c b ON b.cy = j AND b.cx = i + 1 LEFT JOIN c e ON e.cy = j + 1 AND e.cx = i LEFT JOIN c h ON h.cy =
    j + 1 AND h.cx = i + 1
  WHERE a.cy IS NOT NULL OR b.cy IS NOT NULL OR e.cy IS NOT NULL OR h.cy IS NOT NULL""")
def int06_int07_bilinear(spark, d):
    iy, ix = _C.key(F.col("x"), F.col("y"))
    c = regrid.bucket_mean(positions(spark, d).withColumns({"iy": iy, "ix": ix}).filter("iy IS NOT NULL"), ["iy", "ix"], "elev", out="value")
    return interp.bilinear(c, _C, grid(KM50).cells(spark), keys=()).select("iy", "ix", *_r("value", digits=8))


def _gap_sql(src: str, line: str, axis: str) -> str:
    w = f"PARTITION BY {line} ORDER BY {axis} ROWS BETWEEN"
    return f"""(SELECT time, iy, ix, coalesce(v, CASE WHEN nx_ - px_ <= 10 THEN pv + (nv - pv) * ({axis} - px_) / nullif(nx_ - px_, 0) END) AS v FROM (SELECT *,
      last_value(v IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, last_value(CASE WHEN v IS NOT NULL THEN {axis}::DOUBLE END
    IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS px_,
      first_value(v IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv, first_value(CASE WHEN v IS NOT NULL THEN {axis}::DOUBLE END
    IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx_ FROM {src}))"""


@query(f"WITH {_WEATHER}, c AS (SELECT time, iy, ix, tmax AS v FROM cube) SELECT time, iy, ix, round(v, 5) AS tmax FROM {_gap_sql(_gap_sql('c', 'time, iy', 'ix'), 'time, ix', 'iy')}")
def int08_gap_fill(spark, d):
    return interp.fill_gaps_2d(weather_cube(spark, d), "tmax").select("time", "iy", "ix", *_r("tmax", digits=5))


@query(f"WITH {_positions_sql()} SELECT station_id, round(x, 3) AS x, round(y, 3) AS y FROM sta")
def int09_laea_forward(spark, d):
    return positions(spark, d).select("station_id", *_r("x", "y", digits=3))


@query(f"WITH {_positions_sql()} SELECT station_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM sta")
def int10_laea_inverse(spark, d):
    lat, lon = proj().inverse(F.col("x"), F.col("y"))
    return positions(spark, d).select("station_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def _grid_sql() -> str:
    x, y = _laea_sql()
    b = BOX
    return f"""WITH c AS (SELECT {x} AS x, {y} AS y FROM (VALUES ({b['lat_min']}, {b['lon_min']}), ({b['lat_min']}, {b['lon_max']}), ({b['lat_max']},
    {b['lon_min']}), ({b['lat_max']}, {b['lon_max']})) t(lat, lon)),
      g AS (SELECT floor(min(x) / 1e5) * 1e5 AS x0, ceil(max(x) / 1e5) * 1e5 AS x1, floor(min(y) / 1e5) * 1e5 AS y0, ceil(max(y) / 1e5) * 1e5 AS y1
    FROM c)
      SELECT a.i AS iy, b.i AS ix, y0 + a.i * 1e5 AS y, x0 + b.i * 1e5 AS x FROM g, generate_series(0, 60) a(i), generate_series(0, 60) b(i) WHERE x0
    + b.i * 1e5 <= x1 AND y0 + a.i * 1e5 <= y1"""


@query(_grid_sql().replace("SELECT a.i AS iy, b.i AS ix", "SELECT CAST(a.i AS INT) AS iy, CAST(b.i AS INT) AS ix"))
def int11_src07_src08_target_grid(spark, d):
    return grid(KM100).cells(spark)


# --- alignment ---------------------------------------------------------------------------------------------------

@query(f"""WITH {_WEATHER}, a AS (SELECT time, iy, ix, tmax FROM cube WHERE tmax IS NOT NULL), b AS (SELECT time, iy, ix, prcp FROM cube WHERE prcp IS NOT NULL)
  SELECT time, iy, ix, round(tmax, 3) AS tmax, round(prcp, 3) AS prcp FROM a JOIN b USING (time, iy, ix)""")
def join06_inner_align(spark, d):
    c = weather_cube(spark, d)
    a, b = c.select("time", "iy", "ix", "tmax").filter("tmax IS NOT NULL"), c.select("time", "iy", "ix", "prcp").filter("prcp IS NOT NULL")
    return align.inner_align([a, b]).select("time", "iy", "ix", *_r("tmax", "prcp", digits=3))


@query(f"""WITH {_LAI}, days AS (SELECT CAST(unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS DATE) AS day FROM lai), m AS (SELECT day, (SELECT
    max(time) FROM lai WHERE time <= day) AS obs FROM days)
  SELECT day AS time, iy, ix, round(LAI_norm, 6) + 0 AS LAI_norm, CASE WHEN day = obs THEN LAI_flag ELSE 2 END AS LAI_flag FROM m JOIN lai ON lai.time
    = m.obs""")
def join07_join08_win03_asof_daily(spark, d):
    return align.asof_daily(lai_cube(spark, d)).select("time", "iy", "ix", *_r("LAI_norm"), "LAI_flag")


@query(f"""WITH y(y) AS (VALUES {', '.join(f"(DATE '{x}')" for x in LC_YEARS)}), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
  SELECT date, coalesce((SELECT max(y) FROM y WHERE y <= make_date(year(date), 1, 1)), (SELECT min(y) FROM y)) AS lc_year FROM o""")
def join09_asof_year(spark, d):
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    years = spark.createDataFrame([(y,) for y in LC_YEARS], "year_start string").select(F.col("year_start").cast("date").alias("year_start"))
    return align.asof_year(dates, years)


@query(f"""WITH {_WEATHER}, r AS (SELECT min(iy) AS a, max(iy) AS b, min(ix) AS c, max(ix) AS d FROM cube)
  SELECT time, iy, ix, round((iy - a) / nullif(b - a, 0), 6) AS lat_norm, round((ix - c) / nullif(d - c, 0), 6) AS lon_norm FROM cube, r""")
def join10_join12_agg08_scl04_static_norms(spark, d):
    c = weather_cube(spark, d)
    cells = features.coordinate_norms(c.select("iy", "ix").distinct().withColumns({"y": F.col("iy").cast("double"), "x": F.col("ix").cast("double")}))
    return align.attach_static(c.select("time", "iy", "ix"), cells, columns=["lat_norm", "lon_norm", "latitude"]).select("time", "iy", "ix", *_r("lat_norm", "lon_norm"))


@query(f"""WITH {_positions_sql()}, r AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM sta) SELECT station_id, round((lat - a) / (b -
    a), 6) AS lat_norm, round((lon - c) / (d - c), 6) AS lon_norm FROM sta, r""")
def scl05_geographic_norms(spark, d):
    return features.coordinate_norms(positions(spark, d), "lat", "lon").select("station_id", *_r("lat_norm", "lon_norm"))


# --- features ---------------------------------------------------------------------------------------------------

@query(f"WITH {_WEATHER} SELECT round(avg(tmax), 6) AS tmax_mean, round(stddev_pop(tmax), 6) AS tmax_std, round(avg(ln(1 + prcp)), 6) AS prcp_mean, round(stddev_pop(ln(1 + prcp)), 6) AS prcp_std FROM cube WHERE time <= DATE '{TRAIN_END}'")
def agg03_train_stats(spark, d):
    s = features.train_stats(weather_cube(spark, d), {"tmax": F.col("tmax"), "prcp": F.log1p("prcp")}, TRAIN_END)
    return spark.createDataFrame([(*s["tmax"], *s["prcp"])], "tmax_mean double, tmax_std double, prcp_mean double, prcp_std double").select(*_r("tmax_mean", "tmax_std", "prcp_mean", "prcp_std"))


_NORMS = f"""{_WEATHER}, t AS (SELECT avg(tmax) AS m1, stddev_pop(tmax) AS s1, avg(tmin) AS m2, stddev_pop(tmin) AS s2, avg(ln(1 + prcp)) AS m3, stddev_pop(ln(1 +
    prcp)) AS s3 FROM cube WHERE time <= DATE '{TRAIN_END}'),
  f AS (SELECT time, iy, ix, coalesce((tmax - m1) / s1, 0) AS tmax_norm, coalesce((tmin - m2) / s2, 0) AS tmin_norm, coalesce((ln(1 + prcp) - m3) /
    s3, 0) AS prcp_norm,
  CAST(tmax IS NOT NULL AND tmin IS NOT NULL AS INT) AS temp_flag, CAST(prcp IS NOT NULL AS INT) AS prcp_flag FROM cube, t)"""


def _weather_features(spark: SparkSession, d: str) -> DataFrame:
    return features.weather_features(weather_cube(spark, d), TRAIN_END)


@query(f"WITH {_NORMS} SELECT time, iy, ix, {_rs('tmax_norm', 'tmin_norm', 'prcp_norm')}, temp_flag, prcp_flag FROM f")
def scl01_scl02_scl06_scl07_weather_norms(spark, d):
    return _weather_features(spark, d).select("time", "iy", "ix", *_r("tmax_norm", "tmin_norm", "prcp_norm"), "temp_flag", "prcp_flag")


@query(f"""WITH {_NORMS} SELECT CASE WHEN time < DATE '2022-03-01' THEN 'train' ELSE 'test' END AS part, round(avg(CASE WHEN temp_flag = 1 THEN tmax_norm END),
    6) AS mean, round(stddev_pop(CASE WHEN temp_flag = 1 THEN tmax_norm END), 6) AS std,
  count(CASE WHEN temp_flag = 1 THEN 1 END) AS n_valid, count(CASE WHEN temp_flag <> 1 THEN 1 END) AS n_missing FROM f GROUP BY 1""")
def agg04_norm_check(spark, d):
    return features.norm_check(_weather_features(spark, d), "tmax_norm", "temp_flag", "2022-03-01").select("part", *_r("mean", "std"), "n_valid", "n_missing")


@query(f"""WITH {_NORMS} SELECT count(*) FILTER (temp_flag = 1 AND prcp_flag = 1) AS "both", count(*) FILTER (temp_flag = 1 AND prcp_flag <> 1) AS only_a,
    count(*) FILTER (temp_flag <> 1 AND prcp_flag = 1) AS only_b,
  count(*) FILTER (temp_flag <> 1 AND prcp_flag <> 1) AS neither, round(avg(CASE WHEN temp_flag <> prcp_flag THEN 1.0::DOUBLE ELSE 0 END), 6) AS
    disagreement FROM f""")
def agg05_flag_agreement(spark, d):
    return features.flag_agreement(_weather_features(spark, d)).withColumn("disagreement", F.round("disagreement", 6))


@query(f"WITH {_NORMS} SELECT time, iy, ix, CAST(temp_flag = 1 AND prcp_flag = 1 AS INT) AS weather_flag FROM f")
def scl08_weather_flag(spark, d):
    return features.combine_flags(_weather_features(spark, d), limit=1.0).select("time", "iy", "ix", "weather_flag")


@query(f"""WITH l AS (SELECT {_PERIOD_START} AS time, iy, ix, avg(CASE WHEN LAI_flag = 1 AND isfinite(LAI_aggregated) THEN CAST(LAI_aggregated AS DOUBLE) END) AS
    v FROM lai_readings GROUP BY 1, 2, 3),
  t AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM l WHERE time <= DATE '2021-12-31') SELECT time, iy, ix, CAST(v IS NOT NULL AS INT) AS LAI_flag,
    round(coalesce((v - m) / s, 0), 6) AS LAI_norm FROM l, t""")
def scl03_flt09_lai_features(spark, d):
    r = table(spark, d, "lai_readings").withColumn("time", period_start(period_of(F.col("time"))))
    ok = F.when(F.col("LAI_flag") == 1, in_range(F.col("LAI_aggregated"), -1e30, 1e30))
    c = r.groupBy("time", "iy", "ix").agg(F.avg(ok).alias("v"))
    return features.lai_features(c, "v", "2021-12-31").select("time", "iy", "ix", "LAI_flag", *_r("LAI_norm"))


_ROLL = f"""{_WEATHER}, s AS (SELECT time, iy, ix,
    {', '.join(f"CASE WHEN count(prcp) OVER w{w} >= {w // 2} THEN sum(prcp) OVER w{w} END AS s{w}" for w in (14, 30, 60))} FROM cube
  WINDOW {', '.join(f"w{w} AS (PARTITION BY iy, ix ORDER BY time ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (14, 30, 60))})"""


@query(f"WITH {_ROLL} SELECT time, iy, ix, {', '.join(f'round(s{w}, 3) AS prcp_{w}d' for w in (14, 30, 60))} FROM s")
def win01_rolling_sum(spark, d):
    return weather_cube(spark, d).select("time", "iy", "ix", *[F.round(features.rolling_sum(F.col("prcp"), w), 3).alias(f"prcp_{w}d") for w in (14, 30, 60)])


@query(f"""WITH {_ROLL}, t AS (SELECT {', '.join(f'avg(s{w}) AS m{w}, stddev_pop(s{w}) AS d{w}' for w in (14, 30, 60))} FROM s WHERE time <= DATE '{TRAIN_END}')
  SELECT time, iy, ix, {', '.join(f'round(coalesce((s{w} - m{w}) / d{w}, 0), 6) AS prcp_{w}d_norm' for w in (14, 30, 60))} FROM s, t""")
def win02_rolling_norms(spark, d):
    return features.rolling_norms(weather_cube(spark, d), "prcp", (14, 30, 60), TRAIN_END).select("time", "iy", "ix", *_r("prcp_14d_norm", "prcp_30d_norm", "prcp_60d_norm"))


@query("""SELECT p_partkey, CAST(c IN (1, 2) AS INT) AS lc_ev_trees, CAST(c IN (3, 4) AS INT) AS lc_dc_trees, CAST(c = 5 AS INT) AS lc_shrub, CAST(c = 6 AS INT)
    AS lc_grass, CAST(c = 7 AS INT) AS lc_c_crop, CAST(c = 8 AS INT) AS lc_b_crop
  FROM (SELECT p_partkey, p_size % 12 AS c FROM part)""")
def scl09_one_hot(spark, d):
    p = features.land_cover_groups(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 12).alias("c")), "c")
    return p.select("p_partkey", *align.land_cover_columns(p))


@query("""SELECT round(avg(CAST(c IN (1, 2) AS INT)), 6) AS lc_ev_trees, round(avg(CAST(c IN (3, 4) AS INT)), 6) AS lc_dc_trees, round(avg(CAST(c = 5 AS INT)),
    6) AS lc_shrub, round(avg(CAST(c = 6 AS INT)), 6) AS lc_grass,
  round(avg(CAST(c = 7 AS INT)), 6) AS lc_c_crop, round(avg(CAST(c = 8 AS INT)), 6) AS lc_b_crop, CAST(max(CASE WHEN c BETWEEN 1 AND 8 THEN 1 ELSE 0
    END) AS INT) AS most FROM (SELECT p_size % 12 AS c FROM part)""")
def agg09_group_fractions(spark, d):
    p = features.land_cover_groups(table(spark, d, "part").select((F.col("p_size") % 12).alias("c")), "c")
    f = features.group_fractions(p)
    return f.select(*_r(*[c for c in f.columns if c != "most"]), "most")


@query("""WITH y AS (SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT max(year) AS last FROM y)
  SELECT CAST(year AS INT) AS year, o_orderstatus, n FROM y UNION ALL SELECT 2025, o_orderstatus, n FROM y, m WHERE year = last AND last < 2025""")
def win07_pad_last_year(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))
    return features.pad_last_year(y, "year", 2025)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, round(sin(2 * pi() * dayofyear(o_orderdate) / 365), 9) AS doy_sin, round(cos(2 * pi() * dayofyear(o_orderdate) / 365), 9) AS doy_cos FROM orders")
def scl10_doy_encoding(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    s, c = doy_encoding(F.col("day"))
    return o.select("day", F.round(s, 9).alias("doy_sin"), F.round(c, 9).alias("doy_cos"))


@query("WITH s AS (SELECT avg(ln(1 + value)) AS m, stddev_pop(ln(1 + value)) AS d FROM events) SELECT event_id, round((ln(1 + value) - m) / d, 6) AS value_norm FROM events, s")
def scl02_log_zscore(spark, d):
    e = table(spark, d, "events")
    m, s = features.train_stats(e, {"v": F.log1p("value")})["v"]
    return e.select("event_id", F.round(log_zscore(F.col("value"), m, s), 6).alias("value_norm"))


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem WHERE l_returnflag <> 'R')
  SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag <> 'R' THEN (l_extendedprice - m) / d ELSE 0 END, 6) AS price_norm FROM
    lineitem, s""")
def scl03_masked_zscore(spark, d):
    x = table(spark, d, "lineitem").withColumn("flag", (F.col("l_returnflag") != "R").cast("int"))
    m, s = features.train_stats(x, {"v": F.when(F.col("flag") == 1, F.col("l_extendedprice"))})["v"]
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(masked_zscore(F.col("l_extendedprice"), F.col("flag"), m, s), 6).alias("price_norm"))


# --- windows, samples, metrics, forecasts ------------------------------------------------------------------------

def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, windows.WindowSpec]:
    """The weather cube with step numbers, and its window sizes (14 in, 14 out, every 14 days, patches of 3 x 3)."""
    c = windows.time_index(_weather_features(spark, d))
    r = c.agg(F.max("it"), F.max("iy"), F.max("ix")).first()
    return c, windows.WindowSpec((r[0] if r[0] is not None else -1) + 1, (r[1] or 0) + 1, (r[2] or 0) + 1, 14, 14, 14, 3)


_STEPS = "steps AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS it FROM (SELECT DISTINCT time FROM cube)), n AS (SELECT count(*) AS t, CAST(floor((count(*) - 28) / 14) + 1 AS INT) AS n_seq FROM steps)"


@query(f"""WITH {_WEATHER}, {_STEPS}, q AS (SELECT CAST(unnest(generate_series(0, (SELECT n_seq FROM n) - 1)) AS INT) AS seq)
  SELECT q.seq, CASE WHEN s.it - q.seq * 14 < 14 THEN 'x' ELSE 'y' END AS role, count(*) AS cells, min(s.time) AS first, max(s.time) AS last
  FROM q JOIN steps s ON s.it BETWEEN q.seq * 14 AND q.seq * 14 + 27 JOIN cube c ON c.time = s.time GROUP BY 1, 2""")
def win06_flt08_sequence_windows(spark, d):
    c, spec = _indexed(spark, d)
    return windows.sequence_windows(c, spec).groupBy("seq", "role").agg(F.count("*").alias("cells"), F.min("time").alias("first"), F.max("time").alias("last"))


_PATCHES = f"""{_NORMS}, st AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS it FROM (SELECT DISTINCT time FROM cube)), sz AS (SELECT CAST(floor((max(iy) +
    1) / 3) AS INT) AS py, CAST(floor((max(ix) + 1) / 3) AS INT) AS px FROM cube),
  f0 AS (SELECT min(it) AS it FROM f JOIN st USING (time) WHERE temp_flag = 1), p AS (SELECT CAST(floor(iy / 3) AS INT) AS lat_patch, CAST(floor(ix /
    3) AS INT) AS lon_patch, temp_flag FROM f JOIN st USING (time) JOIN f0 USING (it)),
  v AS (SELECT lat_patch, lon_patch, avg(CASE WHEN temp_flag <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM p, sz WHERE lat_patch < py AND
    lon_patch < px GROUP BY 1, 2 HAVING fraction >= 0.5)"""


@query(f"WITH {_PATCHES} SELECT lat_patch, lon_patch, round(fraction, 6) AS fraction FROM v")
def agg10_scl14_valid_patches(spark, d):
    c, spec = _indexed(spark, d)
    return windows.valid_patches(c, spec, 0.5, flag="temp_flag").select("lat_patch", "lon_patch", *_r("fraction"))


@query(f"""WITH {_PATCHES}, n AS (SELECT CAST(floor((count(*) - 28) / 14) + 1 AS INT) AS n_seq FROM st), q AS (SELECT CAST(unnest(generate_series(0, (SELECT
    n_seq FROM n) - 1)) AS INT) AS seq)
  SELECT CAST(seq * py * px + lon_patch * py + lat_patch AS BIGINT) AS sample_id, seq, seq * 14 AS seq_start, lat_patch, lon_patch FROM v, q, sz""")
def ds01_ds02_scl13_sample_index(spark, d):
    c, spec = _indexed(spark, d)
    return windows.sample_index(spec, windows.valid_patches(c, spec, 0.5, flag="temp_flag"))


LC_SLICES = ("2021-01-01", "2022-01-01")
_GROUPS_SQL = ("(1, 2)", "(3, 4)", "(5)", "(6)", "(7)", "(8)")


def _land_cover(spark: SparkSession, c: DataFrame) -> DataFrame:
    """Invented annual land cover of the cube's cells: ``year_start, iy, ix`` and six one-hot columns."""
    years = [F.lit(y).cast("date") for y in LC_SLICES]
    cells = c.select("iy", "ix").distinct().withColumn("year_start", F.explode(F.array(*years)))
    return features.land_cover_groups(cells.withColumn("c", (F.col("iy") * 7 + F.col("ix") * 3 + F.year("year_start")) % 12), "c")


_SAMPLES = f"""{_PATCHES}, n AS (SELECT CAST(floor((count(*) - 28) / 14) + 1 AS INT) AS n_seq FROM st), q AS (SELECT CAST(unnest(generate_series(0, (SELECT n_seq
    FROM n) - 1)) AS INT) AS seq),
  smp AS (SELECT CAST(seq * py * px + lon_patch * py + lat_patch AS BIGINT) AS sample_id, seq, lat_patch, lon_patch FROM v, q, sz)"""
_CHANNELS = ("tmax_norm", "tmin_norm", "prcp_norm", "temp_flag")


@query(f"""WITH {_SAMPLES}, e AS (SELECT f.*, it, CAST(floor(iy / 3) AS INT) AS lat_patch, CAST(floor(ix / 3) AS INT) AS lon_patch FROM f JOIN st USING (time)),
  g AS (SELECT sample_id,
    {', '.join(f"coalesce(sum(CASE WHEN it < seq * 14 + 14 THEN CAST({c} AS FLOAT)::DOUBLE END), 0) AS c{k}" for k, c in enumerate(_CHANNELS))},
    coalesce(sum(CASE WHEN it >= seq * 14 + 14 THEN CAST(tmax_norm AS FLOAT)::DOUBLE END), 0) AS y,
        CAST(coalesce(sum(CASE WHEN it >= seq * 14 + 14 THEN temp_flag END), 0) AS BIGINT) AS flag
        FROM smp LEFT JOIN e ON e.lat_patch = smp.lat_patch AND e.lon_patch = smp.lon_patch AND it BETWEEN seq * 14 AND seq * 14 + 27 GROUP BY
    sample_id),
  yr AS (SELECT q.seq, CASE WHEN make_date(year(time), 1, 1) >= DATE '{LC_SLICES[1]}' THEN 2022 ELSE 2021 END AS y FROM q JOIN st ON st.it = q.seq *
    14),
  lc AS (SELECT sample_id,
    {', '.join(f"14 * count(CASE WHEN (iy * 7 + ix * 3 + y) % 12 IN {m} THEN 1 END)::DOUBLE AS c{k + 4}" for k, m in enumerate(_GROUPS_SQL))}
         FROM smp JOIN yr USING (seq) JOIN (SELECT DISTINCT iy, ix FROM cube) c ON floor(iy / 3) = lat_patch AND floor(ix / 3) = lon_patch GROUP BY
    sample_id),
  dy AS (SELECT seq, sum(CASE WHEN it < seq * 14 + 14 THEN sin(2 * pi() * dayofyear(time) / 365) + cos(2 * pi() * dayofyear(time) / 365) END) AS
    doy_x,
         sum(CASE WHEN it >= seq * 14 + 14 THEN sin(2 * pi() * dayofyear(time) / 365) + cos(2 * pi() * dayofyear(time) / 365) END) AS doy_y FROM q
    JOIN st ON it BETWEEN seq * 14 AND seq * 14 + 27 GROUP BY seq)
  SELECT sample_id, seq * 14 AS seq_start, {', '.join(f"round(c{k}, 3) + 0 AS c{k}" for k in range(10))}, round(y, 3) + 0 AS y, flag, round(doy_x, 6)
    + 0 AS doy_x, round(doy_y, 6) + 0 AS doy_y FROM smp JOIN g USING (sample_id) JOIN lc USING (sample_id) JOIN dy USING (seq)""")
def ds03_join11_scl17_samples(spark, d):
    """Sums over the tensors of every training sample: per channel, land cover of the window's first year included."""
    c, spec = _indexed(spark, d)
    lc = _land_cover(spark, c)
    s = windows.materialise(c, spec, _CHANNELS, "tmax_norm", "temp_flag", _samples(c, spec), land_cover=lc, land_cover_features=align.land_cover_columns(lc))
    return _tensor_sums(s, 10, spec)


def _samples(c: DataFrame, spec: windows.WindowSpec) -> DataFrame:
    return windows.sample_index(spec, windows.valid_patches(c, spec, 0.5, flag="temp_flag"))


def _tensor_sums(s: DataFrame, channels: int, spec: windows.WindowSpec) -> DataFrame:
    size = spec.patch * spec.patch
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v.cast("double"))
    channel = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(spec.l_in - 1)), F.lit(0.0), lambda t, i: t + add(F.slice("x", i * (channels * size) + (k * size + 1), F.lit(size))))
    zero = lambda c, digits: F.round(c, digits) + F.lit(0.0)
    return s.select("sample_id", "seq_start", *[zero(channel(k), 3).alias(f"c{k}") for k in range(channels)], zero(add(F.col("y")), 3).alias("y"),
                    F.aggregate("flag_y", F.lit(0).cast("long"), lambda t, v: t + v).alias("flag"), zero(add(F.col("doy_x")), 6).alias("doy_x"), zero(add(F.col("doy_y")), 6).alias("doy_y"))


@query(f"WITH {_SAMPLES} SELECT sample_id, CAST(0 AS BIGINT) AS flag, CAST(126 AS INT) AS cells FROM smp")
def ds04_samples_without_mask(spark, d):
    c, spec = _indexed(spark, d)
    s = windows.materialise(c, spec, ["tmax_norm"], "tmax_norm", "no such mask", _samples(c, spec))
    return s.select("sample_id", F.aggregate("flag_y", F.lit(0).cast("long"), lambda t, v: t + v).alias("flag"), F.size("flag_y").alias("cells"))


@query(f"""WITH {_SAMPLES}, k AS (SELECT count(*) AS n FROM smp) SELECT part, least(greatest(n - before, 0), size) AS samples, least(greatest(n - before, 0),
    size) AS of_index, CAST(0 AS BIGINT) AS shared
  FROM k, (VALUES ('train', 0, 32), ('val', 32, 8)) p(part, before, size)""")
def ds05_sample_subset(spark, d):
    """Sizes of the two parts of a subset of 40 samples (0.8 for training), and that they are distinct samples of the index."""
    c, spec = _indexed(spark, d)
    index = _samples(c, spec)
    train, val = windows.sample_subset(index, 40, 0.8)
    count = lambda name, df, other: df.join(index.select(F.col("sample_id").alias("known")), F.col("sample_id") == F.col("known"), "left").agg(
        F.lit(name).alias("part"), F.count_distinct("sample_id").alias("samples"), F.count("known").alias("of_index")).crossJoin(df.join(other, "sample_id").agg(F.count("*").alias("shared")))
    return count("train", train, val).unionByName(count("val", val, train))


@query("""WITH c AS (SELECT count(DISTINCT time) AS t, max(iy) + 1 AS ny, max(ix) + 1 AS nx FROM weather_daily), n AS (SELECT greatest(floor((t - 28) / 14) + 1,
    0) * floor(ny / 3) * floor(nx / 3) AS n FROM c),
  b AS (SELECT CAST(unnest(generate_series(0, CAST(ceil(n / 64.0) AS BIGINT) - 1)) AS BIGINT) AS batch FROM n) SELECT batch, CAST(least(64, n - batch
    * 64) AS BIGINT) AS samples FROM b, n""")
def ds06_batches(spark, d):
    """Shuffled batches of 64 samples each, the last one smaller."""
    c, spec = _indexed(spark, d)
    b = windows.batches(windows.sample_index(spec, windows.valid_patches(c, spec, 0.0)), 64, seed=1)
    return b.groupBy("batch").agg(F.count_distinct("sample_id").alias("samples"))


def _lai_steps(spark: SparkSession, d: str) -> DataFrame:
    return windows.time_index(lai_cube(spark, d))


_FC = f"""{_LAI}, st AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS it FROM (SELECT DISTINCT time FROM lai)), c AS (SELECT lai.*, it FROM lai JOIN st
    USING (time)), l AS (SELECT max(it) AS last FROM c),
  lead AS (SELECT CAST(unnest(generate_series(1, 5)) AS INT) AS lead)"""


@query(f"""WITH {_FC} SELECT time AS init_date, 0 AS lead, iy, ix, round(LAI_norm, 6) + 0 AS LAI_norm FROM c WHERE it >= 3
  UNION ALL SELECT time, lead, iy, ix, round(CASE WHEN it + 5 <= last THEN LAI_norm ELSE 0 END, 6) + 0 FROM c, l, lead WHERE it >= 3""")
def fc01_fc03_forecast_cube(spark, d):
    c = _lai_steps(spark, d)
    return forecast.forecast_cube(c, forecast.persistence(c, 4, 5), 4, 5).select("init_date", "lead", "iy", "ix", *_r("LAI_norm"))


@query(f"""WITH {_FC} SELECT time AS init_date, CAST(time + lead AS DATE) AS valid_date, lead, iy, ix, round(LAI_norm, 6) + 0 AS LAI_norm FROM c, l, lead WHERE
    it >= 3 AND it + 5 <= last AND lead BETWEEN 2 AND 4""")
def fc05_win08_lead_range(spark, d):
    c = _lai_steps(spark, d)
    f = forecast.forecast_cube(c, forecast.persistence(c, 4, 5), 4, 5, tail="drop", leads=forecast.Leads(2, 4))
    return forecast.valid_date(f).select("init_date", "valid_date", "lead", "iy", "ix", *_r("LAI_norm"))


@query()
def fc02_ml03_network_forecast(spark, d):
    """ConvLSTM forecasts of the whole area from every period, with a network of fixed random weights."""
    c = _lai_steps(spark, d).withColumn("flag_f", F.col("LAI_flag").cast("double"))
    r = c.agg(F.max("it"), F.max("iy"), F.max("ix")).first()
    spec = windows.WindowSpec(r[0] + 1, r[1] + 1, r[2] + 1, 3, 2)
    w = forecast.random_weights(2, 4)
    p = forecast.predict(c, spec, ["LAI_norm", "flag_f"], w)
    f = forecast.forecast_cube(c, p, 3, 2, tail="drop", half=True)
    return f


_SCORE = f"""{_FC}, s AS (SELECT lead.lead, c.time AS init_date, c.iy, c.ix, c.LAI_norm AS p, t.LAI_norm AS y, t.LAI_flag AS f FROM c, l, lead JOIN c t ON true
    WHERE c.it >= 3 AND c.it + 5 <= last AND t.iy = c.iy AND t.ix = c.ix AND t.time = c.time + 4 * lead.lead)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Persistence forecasts beside the later observations; leads count periods of four days here."""
    c = _lai_steps(spark, d)
    f = forecast.forecast_cube(c, forecast.persistence(c, 4, 5), 4, 5, tail="drop").filter("lead > 0")
    days = f.withColumns({"periods": F.col("lead"), "lead": F.col("lead") * 4})
    return forecast.score(days, c).withColumn("lead", (F.col("lead") / 4).cast("int"))


@query(f"""WITH {_SCORE} SELECT lead, round(coalesce(avg(CASE WHEN f = 1 THEN (p - y) ** 2 END), 0), 6) AS mse, round(coalesce(avg(CASE WHEN f = 1 THEN abs(p -
    y) END), 0), 6) AS mae,
  round(coalesce(sqrt(avg(CASE WHEN f = 1 THEN (p - y) ** 2 END)), 0), 6) AS rmse, count(CASE WHEN f = 1 THEN 1 END) AS n_valid FROM s GROUP BY lead""")
def agg12_join13_masked_metrics_by_lead(spark, d):
    return metrics.masked_metrics(_scored(spark, d), ["lead"]).select("lead", *_r("mse", "mae", "rmse"), "n_valid")


@query(f"WITH {_SCORE} SELECT round(coalesce(avg(CASE WHEN f = 1 THEN (p - y) ** 2 END), 0), 6) AS mse FROM s")
def agg11_masked_mse(spark, d):
    return metrics.masked_mse(_scored(spark, d)).select(*_r("mse"))


@query(f"WITH {_SCORE} SELECT lead, round(sqrt(avg(CASE WHEN f = 1 THEN (p - y) ** 2 END)), 6) AS rmse, round(avg(CASE WHEN f = 1 THEN abs(p - y) END), 6) AS mae, count(CASE WHEN f = 1 THEN 1 END) AS n_valid FROM s GROUP BY lead")
def agg13_error_sums(spark, d):
    parts = metrics.error_sums(_scored(spark, d), ["init_date", "lead"])
    return metrics.merge_error_sums(parts).select("lead", *_r("rmse", "mae"), "n_valid")


@query(f"WITH {_SCORE}, b AS (SELECT init_date, coalesce(avg(CASE WHEN f = 1 THEN (p - y) ** 2 END), 0) AS mse FROM s GROUP BY 1) SELECT round(avg(mse), 6) AS mse, count(*) AS batches FROM b")
def agg14_mean_of_batches(spark, d):
    return metrics.mean_of_batches(_scored(spark, d), "init_date").select(*_r("mse"), "batches")


@query(f"WITH {_OBS} SELECT DISTINCT date FROM obs")
def agg16_win04_dates(spark, d):
    return st.observed_dates(observations(spark, d))


@query(f"WITH {_OBS} SELECT station_id, date, round(value, 3) AS tmax FROM obs WHERE element = 'TMAX'")
def win05_snk01_extract_variable(spark, d):
    return st.extract_variable(observations(spark, d), "TMAX").select("station_id", "date", *_r("tmax", digits=3))


@query(f"WITH {_WEATHER} SELECT time, iy, ix, round(tmax, 3) AS tmax FROM cube WHERE time NOT IN (SELECT time FROM cube WHERE time < DATE '2022-01-01')")
def snk03_snk04_new_steps(spark, d):
    c = weather_cube(spark, d)
    return new_steps(c, c.filter("time < '2022-01-01'")).select("time", "iy", "ix", *_r("tmax", digits=3))


_UNIT = "pow(2.0::DOUBLE, greatest(floor(log2(abs(nullif(LAI_norm, 0)))), -14) - 10)"


@query(f"WITH {_LAI} SELECT time, iy, ix, coalesce(round_even(LAI_norm / {_UNIT}, 0) * {_UNIT}, 0) + 0 AS LAI_norm FROM lai")
def fc08_half_precision(spark, d):
    c = lai_cube(spark, d)
    return c.select("time", "iy", "ix", (to_half(F.col("LAI_norm")).cast("double") + F.lit(0.0)).alias("LAI_norm"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS "start", CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS "end", event_type,
    round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2, 3""")
def stream01_windowed_totals(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed_totals(e, "ts", ["event_type"], "value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "n")


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders WHERE o_orderdate <= DATE '1999-12-31') SELECT o_orderkey, round((o_totalprice - m) / d, 9) AS price_norm FROM orders, s")
def scl01_zscore(spark, d):
    o = table(spark, d, "orders")
    m, s = features.train_stats(o, {"v": F.col("o_totalprice")}, "1999-12-31", "o_orderdate")["v"]
    return o.select("o_orderkey", F.round(zscore(F.col("o_totalprice"), m, s), 9).alias("price_norm"))
