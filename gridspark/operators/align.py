"""Sources onto common labels: as-of fills, inner alignment, static fields, variable replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("time", "iy", "ix")


def calendar_of(df: DataFrame, time: str = "time") -> DataFrame:
    """``day, obs_time``: every calendar day from the first to the last observed one, with the last observed day at or
    before it. As large as the calendar: each observed day carries its own stretch, so nothing is gathered."""
    seen = df.select(F.to_date(F.col(time)).alias("obs_time")).filter("obs_time IS NOT NULL").distinct()
    # days are the rows of one calendar, so one ordered partition holds them whatever the size of the cube
    nxt = F.lead("obs_time").over(Window.partitionBy(F.lit(0)).orderBy("obs_time"))
    s = seen.withColumn("until", F.coalesce(F.date_sub(nxt, 1), F.col("obs_time")))
    return s.select(F.explode(F.sequence("obs_time", "until")).alias("day"), "obs_time")


def asof_daily(df: DataFrame, time: str = "time", values: Sequence[str] = ("LAI_norm",), flag: str | None = "LAI_flag", cell: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Observations every few days carried forward to every day, per time step (not per pixel's last valid value).

    The flag keeps its value on observed days and is 2 on all others, also where the observed pixel was invalid.
    """
    cal = calendar_of(df, time)
    d = df.withColumn("__obs", F.to_date(F.col(time))).drop(time)
    d = d.join(cal.withColumnRenamed("obs_time", "__obs"), "__obs")
    cols = [F.col("day").alias(time), *cell, *values]
    if flag:
        cols.append(F.when(F.col("day") == F.col("__obs"), F.col(flag).cast("int")).otherwise(F.lit(2)).alias(flag))
    return d.select(*cols)


def asof_year(dates: DataFrame, years: DataFrame, date: str = "date", year_start: str = "year_start", out: str = "lc_year") -> DataFrame:
    """Each date with the annual slice valid at the start of its year: the last one not later, clipped to the first and
    the last. ``years`` is one row per slice (a table of years, whatever the size of the cube)."""
    y = years.select(F.col(year_start).cast("date").alias("__from")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("__from")
    y = y.withColumns({"__to": F.lead("__from").over(w), "__first": F.row_number().over(w) == 1}).withColumn(out, F.col("__from"))
    # one row per (slice, year it holds for) turns the range into an equi-join
    lo, hi = dates.agg(F.min(F.year(date)), F.max(F.year(date))).first() or (None, None)
    if lo is None:
        return dates.withColumn(out, F.lit(None).cast("date"))
    start = F.when(F.col("__first"), F.least(F.lit(lo), F.year("__from"))).otherwise(F.year("__from") + F.when((F.month("__from") > 1) | (F.dayofmonth("__from") > 1), 1).otherwise(0))
    end = F.coalesce(F.year(F.date_sub("__to", 1)), F.greatest(F.lit(hi), F.year("__from")))
    table = y.withColumns({"__a": start, "__b": end}).filter("__b >= __a").select(out, F.explode(F.sequence("__a", "__b")).alias("__year"))
    return dates.withColumn("__year", F.year(date)).join(table, "__year", "left").drop("__year")


def inner_align(cubes: Sequence[DataFrame], keys: Sequence[str] = KEYS, check: bool = True) -> DataFrame:
    """Inner join of cubes on their labels; raises where they share none."""
    out = cubes[0]
    for c in cubes[1:]:
        out = out.join(c, list(keys))
    if check and out.isEmpty():
        raise ValueError("the cubes share no time step and cell")
    return out


def attach_static(cube: DataFrame, cells: DataFrame, cell: Sequence[str] = ("iy", "ix"), columns: Sequence[str] = ()) -> DataFrame:
    """Fields of the cells beside every time step; those of ``columns`` that ``cells`` lacks are left out."""
    have = [c for c in (columns or [c for c in cells.columns if c not in cell]) if c in cells.columns]
    return cube.join(cells.select(*cell, *have), list(cell), "left")


def replace_variable(cube: DataFrame, other: DataFrame, variable: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The cube with ``variable`` taken from another cube over exactly the same labels; raises if the labels differ."""
    a, b = cube.select(*keys), other.select(*keys)
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    if not a.join(b, on, "left_anti").isEmpty() or not b.join(a, on, "left_anti").isEmpty():
        raise ValueError("the two cubes don't have the same labels")
    return cube.drop(variable).join(other.select(*keys, variable), list(keys))


def drop_variables(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named variables; those it doesn't have are ignored."""
    return df.drop(*names)


def rename_dimensions(df: DataFrame) -> DataFrame:
    """Cubes with dimensions (y, x) under the names (lat, lon)."""
    return df.withColumnsRenamed({"y": "lat", "x": "lon"}) if {"y", "x"} <= set(df.columns) else df


def select_variables(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The keys and the named variables, each once and in order; raises where one is missing."""
    names = list(dict.fromkeys(variables))
    lost = [v for v in names if v not in df.columns]
    if lost:
        raise ValueError(f"missing variables: {', '.join(lost)}")
    return df.select(*keys, *[v for v in names if v not in keys])


def land_cover_columns(df: DataFrame, prefix: str = "lc_") -> list[str]:
    """Names of the one-hot variables; raises where there is none."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError(f"no variable starts with {prefix}")
    return names


def flag_columns(df: DataFrame) -> list[str]:
    """``weather_flag`` where there is one, else the two it is made of."""
    if "weather_flag" in df.columns:
        return ["weather_flag"]
    both = [c for c in ("temp_flag", "prcp_flag") if c in df.columns]
    if len(both) < 2:
        raise ValueError("neither weather_flag nor temp_flag and prcp_flag")
    return both
