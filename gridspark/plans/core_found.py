"""Queries p1_ to p6_ over the tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.impute import FIELDS, fill_missing
from gridspark.operators.parse import parse_clean, parse_errors
from gridspark.operators.regions import assign_regions, neighbour_counts, neighbours
from gridspark.operators.regular_grid import regular_grid
from gridspark.operators.rolling import rolling_totals
from gridspark.operators.spikes import implausible
from gridspark.functions.missing import in_range

WINDOWS = (14, 30, 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lai_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "lai_readings"), ["iy", "ix"], "time", "LAI_norm", "LAI_flag")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    g = _lai_grid(spark, d)
    return g.filter(F.col("mark") != "observed").select("iy", "ix", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return _lai_grid(spark, d).select("iy", "ix", "period_start", F.round("value", 6).alias("lai_norm"), "n_readings", F.round("support", 6).alias("support"), "mark")


def _prcp_rolling(spark: SparkSession, d: str) -> DataFrame:
    carry = {f"{x}_{w}": getattr(F, x)(f"prcp_{w}d_norm") for w in WINDOWS for x in ("min", "max")}
    return rolling_totals(table(spark, d, "weather_daily"), ["iy", "ix"], "time", in_range(F.col("prcp"), 0, 2000), WINDOWS, carry)


def _norms(spark: SparkSession, d: str) -> dict[str, tuple[float, float]]:
    """mean and std by variable: a table of fixed size (one row per variable)."""
    return {r["var"]: (r["mean"], r["std"]) for r in table(spark, d, "norm_stats").filter(F.col("var").startswith("prcp_")).collect()}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r, stats, cases = _prcp_rolling(spark, d), _norms(spark, d), []
    for w in WINDOWS:
        mean, std = stats[f"prcp_{w}d_norm"]
        right = F.when(F.col(f"n_{w}") < w / 2, F.lit(0.0)).otherwise((F.col(f"total_{w}") - mean) / std)
        wrong = (F.abs(F.col(f"min_{w}") - right) > 0.01) | (F.abs(F.col(f"max_{w}") - right) > 0.01)
        cases.append(F.when(wrong, F.lit(w)))
    r = r.filter("has_row").withColumn("window_days", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())))
    return r.select("iy", "ix", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _prcp_rolling(spark, d)
    cols = [x for w in WINDOWS for x in (F.round(f"total_{w}", 3).alias(f"total_{w}"), F.col(f"n_{w}"), F.round(f"mean_{w}", 4).alias(f"mean_{w}"))]
    return r.select("iy", "ix", "day", "has_row", *cols)


NEAR_KM = 5.0


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours(table(spark, d, "stations"), "station_id", "lat", "lon", NEAR_KM)
    return pairs.select(F.col("a").alias("station_id_a"), F.col("b").alias("station_id_b"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Per position with others within 5 km: the station ids on it, how many positions and ids are near, the nearest."""
    n = neighbour_counts(table(spark, d, "stations"), "station_id", "lat", "lon", NEAR_KM)
    return n.withColumn("nearest_km", F.round("nearest_km", 5))


#: polygons (longitudes, latitudes; holes), one of them concave, two sharing an edge, one with a hole and over two others;
#: its sides lie off the stations' four decimals, as the SQL's crossing test leaves out half of a boundary
SECTORS = (
    ("a_ring", (-103.00003, -95.00003, -95.00003, -103.00003), (25.00003, 25.00003, 35.00003, 35.00003), (((-101.00003, -97.00003, -99.00003), (27.00003, 28.00003, 33.00003)),)),
    ("east", (-100.0, -91.0, -91.0, -100.0), (23.0, 23.0, 39.0, 39.0), ()),
    ("west_hook", (-110.0, -100.0, -100.0, -104.0, -104.0, -110.0), (23.0, 23.0, 39.0, 39.0, 30.0, 30.0), ()),
    ("north_west", (-109.5, -104.5, -107.0), (31.0, 31.5, 38.75), ()),
)


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """Sector of each positioned station (the first by name where they overlap)."""
    shapes = spark.createDataFrame([(n, list(x), list(y), [(list(a), list(b)) for a, b in holes]) for n, x, y, holes in SECTORS],
                                   "sector string, xs array<double>, ys array<double>, holes array<struct<xs:array<double>,ys:array<double>>>")
    s = table(spark, d, "stations").filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).groupBy("station_id").agg(F.min(F.struct("lat", "lon")).alias("at"))
    return assign_regions(s.select("station_id", "at.lat", "at.lon"), shapes, "station_id", "lon", "lat", "sector", holes="holes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "obs_by_year")).select("station_id", "date", "element")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flagged readings with their value and the tests that each failed."""
    return implausible(table(spark, d, "obs_by_year")).select("station_id", "date", "element", "value", "spike", "stuck", "impossible")


def p4_rules(spark: SparkSession, d: str) -> DataFrame:
    """The readings that fail the tests for constant runs and for physical ranges."""
    f = implausible(table(spark, d, "obs_by_year")).filter("stuck OR impossible")
    return f.select("station_id", "date", "element", "value", "stuck", "impossible")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors(table(spark, d, "raw_records")).select("line_id", "reason")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return parse_clean(table(spark, d, "raw_records"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(table(spark, d, "weather_daily"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    f = _filled(spark, d)
    names = F.array(*[F.when(F.col(f"{x.name}_filled"), F.lit(x.name)) for x in FIELDS])
    f = f.withColumn("field", F.explode(F.filter(names, lambda c: c.isNotNull())))
    return f.select("iy", "ix", F.date_format("time", "yyyy-MM-dd").alias("day"), "field")


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    f = _filled(spark, d)
    return f.select("iy", "ix", "time", *[c for x in FIELDS for c in (F.round(x.name, 4).alias(x.name), F.col(f"{x.name}_filled"))])


def p6_observed(spark: SparkSession, d: str) -> DataFrame:
    """What was filled, and the observed values as they were."""
    f = _filled(spark, d)
    return f.select("iy", "ix", "time", *[c for x in FIELDS for c in (F.when(~F.col(f"{x.name}_filled"), F.round(x.name, 4)).alias(x.name), F.col(f"{x.name}_filled"))])


def p6_numeric(spark: SparkSession, d: str) -> DataFrame:
    """The filled values of the numeric fields: predictions of the mixed-effects model."""
    f = _filled(spark, d)
    made = F.array(*[F.when(F.col(f"{x.name}_filled"), F.struct(F.lit(x.name).alias("field"), F.round(x.name, 5).alias("value"))) for x in FIELDS if x.name in ("prcp", "tmax")])
    return f.select("iy", "ix", "time", F.explode(F.filter(made, lambda c: c.isNotNull())).alias("v")).select("iy", "ix", "time", "v.field", "v.value")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_totals, p3_found, p3_neighbours, p3_regions, p4_found, p4_flags, p4_rules, p5_found, p5_clean, p6_found, p6_filled, p6_observed, p6_numeric)}
