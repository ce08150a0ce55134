"""Cubes on disk: Parquet tables partitioned by year, read by time range, grown along time, changed variable by variable.

A cube is kept as one table per group of variables, all keyed (time, iy, ix), and read as a joined view, so adding or
replacing a variable never rewrites the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.grid import Grid

KEYS = ("time", "iy", "ix")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan_cube(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, variables: Sequence[str] | None = None) -> DataFrame:
    """The cube's rows between two days (both included); whole years outside are never opened."""
    d = spark.read.parquet(path)
    if start is not None:
        d = d.filter((F.col("time") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if end is not None:
        d = d.filter((F.col("time") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    return d.drop("year") if variables is None else d.select(*KEYS, *variables)


def _write(df: DataFrame, path: str, mode: str, tile: int | None, float32: bool) -> None:
    if float32:
        df = df.select([F.col(f.name).cast("float").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])
    d = df.withColumn("year", F.year("time"))
    if tile:
        # space before time within a file, as windows read it
        d = d.withColumns({"__ty": F.floor(F.col("iy") / tile), "__tx": F.floor(F.col("ix") / tile)})
        d = d.repartitionByRange("year", "__ty", "__tx").sortWithinPartitions("year", "__ty", "__tx", *KEYS).drop("__ty", "__tx")
    d.write.mode(mode).option("compression", "zstd").partitionBy("year").parquet(path)


def create_cube(df: DataFrame, path: str, overwrite: bool = False, tile: int | None = None, float32: bool = True) -> None:
    """Write a new cube; an existing one is only replaced with ``overwrite``."""
    _write(df, path, "overwrite" if overwrite else "errorifexists", tile, float32)


def new_steps(df: DataFrame, stored: DataFrame, time: str = "time") -> DataFrame:
    """Rows of the time steps that ``stored`` doesn't have yet."""
    return df.join(stored.select(time).distinct(), time, "left_anti")


def new_cells(df: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the cells (time step and place) that ``stored``, partitioned by year, doesn't have yet; NULL keys count as equal."""
    first, last = df.agg(F.min(F.year("time")), F.max(F.year("time"))).first()
    years = F.col("year").between(F.lit(first), F.lit(last)) | F.col("year").isNull()
    s = stored.filter(years).select([F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(s, same, "left_anti")


def append_cube(df: DataFrame, path: str, float32: bool = True, by_cell: bool = False) -> None:
    """Add the time steps that aren't stored yet, or with ``by_cell`` the cells; running it again changes nothing."""
    spark = df.sparkSession
    if exists(spark, path):
        stored = spark.read.parquet(path)
        df = new_cells(df, stored) if by_cell else new_steps(df, stored)
    _write(df, path, "append", None, float32)


def put_variables(df: DataFrame, root: str, group: str, keys: Sequence[str] = KEYS) -> None:
    """Store a group of variables of the cube ``root``, replacing what the group held."""
    df.select(*keys, *[c for c in df.columns if c not in keys]).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{group}")


def open_variables(spark: SparkSession, root: str, groups: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The joined view of several groups of variables."""
    d = spark.read.parquet(f"{root}/{groups[0]}")
    for g in groups[1:]:
        d = d.join(spark.read.parquet(f"{root}/{g}"), list(keys))
    return d


def write_grid(spark: SparkSession, grid: Grid, path: str) -> None:
    spark.createDataFrame([(grid.x0, grid.y0, grid.res, grid.nx, grid.ny, grid.crs)], "x0 double, y0 double, res double, nx int, ny int, crs string").coalesce(1).write.mode("overwrite").parquet(path)


def read_grid(spark: SparkSession, path: str) -> Grid:
    r = spark.read.parquet(path).first()
    return Grid(r["x0"], r["y0"], r["res"], r["nx"], r["ny"], r["crs"])


def grid_of(cells: DataFrame, crs: str = "") -> Grid:
    """The grid that a table of cells (``iy, ix, y, x``) lies on."""
    r = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.max("ix"), F.max("iy")).first()
    res = (r[1] - r[0]) / r[4] if r[4] else (r[3] - r[2]) / r[5]
    return Grid(r[0], r[2], res, r[4] + 1, r[5] + 1, crs)


def write_by_variable_year(obs: DataFrame, path: str, csv: bool = True) -> None:
    """Observations in one folder per element and year."""
    w = obs.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("element", "year")
    w.option("header", True).csv(path) if csv else w.option("compression", "zstd").parquet(path)


def write_station_ids(stations: DataFrame, path: str) -> None:
    """The ids as text, one per line."""
    stations.select("station_id").distinct().orderBy("station_id").write.mode("overwrite").text(path)
