"""Station files: observations by year, inventory, id lists, per-variable tables; and what is kept of them."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.missing import finite

log = logging.getLogger("gridspark.sources")

OBSERVATION_COLUMNS = ("station_id", "date", "element", "value", "mflag", "qflag", "sflag", "obs_time")
ELEMENTS = ("TMAX", "TMIN", "PRCP")
#: elements stored in tenths of a degree
SCALED = ("TMAX", "TMIN")
#: the analysis area, and the margin around it from which stations still count (degrees)
TARGET_BOX = {"lat_min": 25.8, "lat_max": 37.2, "lon_min": -108.25, "lon_max": -92.5}
BUFFER = 2.0


def scan_observations(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """By-year files without header, all columns text; only the first four are read from the file."""
    schema = ", ".join(f"{c} string" for c in OBSERVATION_COLUMNS)
    return spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path).select(*OBSERVATION_COLUMNS[:4])


def parse_stations(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fixed-width inventory lines: id, lat, lon, elevation (may be blank), name.

    Lines under 30 characters, and lines on which a number can't be read, are skipped whole.
    """
    t = F.col(line)
    cut = lambda a, n: F.trim(F.substring(t, a, n))
    elev = cut(31, 7)
    d = lines.filter(F.length(t) >= 30).select(cut(1, 11).alias("station_id"), cut(12, 9).try_cast("double").alias("lat"), cut(21, 10).try_cast("double").alias("lon"),
                                               elev.alias("__e"), elev.try_cast("double").alias("elev"), F.trim(t.substr(F.lit(39), F.length(t))).alias("name"))
    return d.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ((F.col("__e") == "") | F.col("elev").isNotNull())).drop("__e")


def scan_stations(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_stations(spark.read.text(path))


def scan_station_ids(spark: SparkSession, path: str) -> DataFrame:
    """``station_id``: one per line, trimmed, blanks dropped, each once."""
    return spark.read.text(path).select(F.trim("value").alias("station_id")).filter("station_id <> ''").distinct()


def scan_variable(spark: SparkSession, paths: Sequence[str], variable: str) -> DataFrame:
    """Per-variable files with a header (``station_id, date, <variable>``); files that aren't there are skipped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            there.append(p)
        else:
            log.warning("no file %s", p)
    schema = f"station_id string, date string, `{variable}` double"
    d = spark.read.schema(schema).option("header", True).csv(there) if there else spark.createDataFrame([], schema)
    return d.withColumn("date", F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), F.try_to_timestamp("date", F.lit("yyyyMMdd"))).cast("date"))


def typed_observations(raw: DataFrame, ids: DataFrame | None = None, elements: Sequence[str] = ELEMENTS, prcp_scale: float = 1.0) -> DataFrame:
    """``station_id, date DATE, element, value DOUBLE`` of the wanted stations and elements; rows whose date or value
    can't be read are dropped. Temperatures become degrees; precipitation stays in tenths of a millimetre unless
    ``prcp_scale`` says otherwise."""
    d = raw.filter(F.col("element").isin(*elements))
    if ids is not None:
        d = d.join(ids.select("station_id"), "station_id", "left_semi")
    day = F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date")
    v = F.trim(F.col("value").cast("string")).try_cast("double")
    d = d.select("station_id", day.alias("date"), "element", v.alias("value")).filter(F.col("date").isNotNull() & finite(F.col("value")))
    return d.withColumn("value", F.when(F.col("element").isin(*SCALED), F.col("value") / 10).otherwise(F.col("value") * prcp_scale))


def extract_variable(obs: DataFrame, element: str) -> DataFrame:
    """``station_id, date, <element in lower case>`` in the order of date and station."""
    return obs.filter(F.col("element") == element).select("station_id", "date", F.col("value").alias(element.lower())).orderBy("date", "station_id")


def in_box(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, buffer: float = BUFFER, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Stations in the box widened by ``buffer`` (ends included), with ``in_target``: in the box itself."""
    def box(b: float) -> Column:
        return F.col(lat).between(lat_min - b, lat_max + b) & F.col(lon).between(lon_min - b, lon_max + b)

    return df.filter(box(buffer)).withColumn("in_target", box(0.0))


def observation_counts(obs: DataFrame) -> DataFrame:
    """Rows and distinct stations per element."""
    return obs.groupBy("element").agg(F.count("*").alias("rows"), F.count_distinct("station_id").alias("stations"))


def observed_dates(obs: DataFrame) -> DataFrame:
    return obs.select("date").distinct().orderBy("date")


def with_stations(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Observations with their station's columns; those of unknown stations are dropped."""
    return obs.join(stations, "station_id")
