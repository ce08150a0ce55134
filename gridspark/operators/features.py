"""Model features of the daily cube: train-period statistics, normalised variables, rolling sums, validity flags,
land-cover groups. Statistics of all variables come from one aggregate; what they are is kept in a side table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions.missing import nan_to_null
from gridspark.functions.scalar import GROUPS_6, log_zscore, masked_zscore, min_max, one_hot, zscore

AGREEMENT_LIMIT = 0.05


def train_slice(df: DataFrame, train_end: str | None, time: str = "time") -> DataFrame:
    """Rows up to and including the last training day."""
    return df if train_end is None else df.filter(F.col(time) <= F.lit(train_end).cast(df.schema[time].dataType))


def split_by_time(df: DataFrame, val_start: str, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """(training rows up to the day before ``val_start``, validation rows from it on)."""
    day = F.to_date(F.col(time))
    start = F.lit(val_start).cast("date")
    return df.filter(day <= F.date_sub(start, 1)), df.filter(day >= start)


def time_range(df: DataFrame, start: str | None = None, end: str | None = None, time: str = "time") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; either may be open."""
    kind = df.schema[time].dataType
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast(kind))
    return df if end is None else df.filter(F.col(time) <= F.lit(end).cast(kind))


def train_stats(df: DataFrame, variables: dict[str, Column], train_end: str | None = None, time: str = "time") -> dict[str, tuple[float | None, float | None]]:
    """(mean, population deviation) of each expression over the training rows, NaN skipped: one pass, one row."""
    aggs = [x for n, c in variables.items() for x in (F.avg(nan_to_null(c.cast("double"))).alias(f"{n}__m"), F.stddev_pop(nan_to_null(c.cast("double"))).alias(f"{n}__s"))]
    r = train_slice(df, train_end, time).agg(*aggs).first()
    return {n: (r[f"{n}__m"], r[f"{n}__s"]) for n in variables}


def stats_table(df: DataFrame, stats: dict[str, tuple[float | None, float | None]], method: str = "zscore", train_end: str | None = None) -> DataFrame:
    """The statistics as rows ``var, method, mean, std, train_end``."""
    rows = [(n, method, m, s, train_end) for n, (m, s) in stats.items()]
    return df.sparkSession.createDataFrame(rows, "var string, method string, mean double, std double, train_end string")


def rolling_sum(value: Column, window: int, cell: Sequence[str] = ("iy", "ix"), time: str = "time", min_periods: int | None = None) -> Column:
    """Sum over the last ``window`` rows of a cell, NULL with fewer than half of them valid."""
    w = Window.partitionBy(*cell).orderBy(time).rowsBetween(-(window - 1), 0)
    v = nan_to_null(value.cast("double"))
    need = max(1, window // 2) if min_periods is None else min_periods
    return F.when(F.count(v).over(w) >= need, F.sum(v).over(w))


def rolling_norms(df: DataFrame, value: str, windows: Sequence[int], train_end: str | None = None, cell: Sequence[str] = ("iy", "ix"), time: str = "time") -> DataFrame:
    """Adds ``<value>_<W>d_norm`` per window: the rolling sum's z-score under training statistics, 0 where missing."""
    d = df.withColumns({f"__s{w}": rolling_sum(F.col(value), w, cell, time) for w in windows})
    stats = train_stats(d, {f"s{w}": F.col(f"__s{w}") for w in windows}, train_end, time)
    d = d.withColumns({f"{value}_{w}d_norm": F.coalesce(zscore(F.col(f"__s{w}"), *(x or 0.0 for x in stats[f"s{w}"])), F.lit(0.0)) for w in windows})
    return d.drop(*[f"__s{w}" for w in windows])


def weather_features(df: DataFrame, train_end: str | None, tmax: str = "tmax", tmin: str = "tmin", prcp: str = "prcp") -> DataFrame:
    """Temperature z-scores, log1p precipitation z-score, all 0 where missing, with ``temp_flag`` (both temperatures
    valid) and ``prcp_flag``."""
    v = {c: nan_to_null(F.col(c).cast("double")) for c in (tmax, tmin, prcp)}
    stats = train_stats(df, {tmax: v[tmax], tmin: v[tmin], prcp: F.log1p(v[prcp])}, train_end)
    num = {n: tuple(x or 0.0 for x in s) for n, s in stats.items()}
    return df.withColumns({
        f"{tmax}_norm": F.coalesce(zscore(v[tmax], *num[tmax]), F.lit(0.0)), f"{tmin}_norm": F.coalesce(zscore(v[tmin], *num[tmin]), F.lit(0.0)),
        f"{prcp}_norm": F.coalesce(log_zscore(v[prcp], *num[prcp]), F.lit(0.0)),
        "temp_flag": (v[tmax].isNotNull() & v[tmin].isNotNull()).cast("int"), "prcp_flag": v[prcp].isNotNull().cast("int")})


def lai_features(df: DataFrame, value: str, train_end: str | None) -> DataFrame:
    """``LAI_flag`` (1 valid, 0 missing) and ``LAI_norm`` (z-score of valid values, else 0)."""
    v = nan_to_null(F.col(value).cast("double"))
    mean, std = (x or 0.0 for x in train_stats(df, {"v": v}, train_end)["v"])
    flag = v.isNotNull().cast("int")
    return df.withColumns({"LAI_flag": flag, "LAI_norm": masked_zscore(v, flag, mean, std)})


def norm_check(df: DataFrame, norm: str, flag: str, val_start: str, time: str = "time") -> DataFrame:
    """Mean and deviation of the valid normalised values before and from ``val_start`` (about 0 and 1 in training)."""
    part = F.when(F.to_date(F.col(time)) < F.lit(val_start).cast("date"), F.lit("train")).otherwise(F.lit("test"))
    v = F.when(F.col(flag) == 1, F.col(norm))
    return df.groupBy(part.alias("part")).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_missing"))


def flag_agreement(df: DataFrame, a: str = "temp_flag", b: str = "prcp_flag") -> DataFrame:
    """One row: the four counts of two flags and the share of rows on which they differ."""
    yes_a, yes_b = F.coalesce(F.col(a) == 1, F.lit(False)), F.coalesce(F.col(b) == 1, F.lit(False))
    d = df.agg(F.count_if(yes_a & yes_b).alias("both"), F.count_if(yes_a & ~yes_b).alias("only_a"), F.count_if(~yes_a & yes_b).alias("only_b"), F.count_if(~yes_a & ~yes_b).alias("neither"))
    n = F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")
    return d.withColumn("disagreement", (F.col("only_a") + F.col("only_b")) / F.nullif(n, F.lit(0)))


def combine_flags(df: DataFrame, a: str = "temp_flag", b: str = "prcp_flag", out: str = "weather_flag", limit: float = AGREEMENT_LIMIT) -> DataFrame:
    """Adds ``out`` (both flags 1) if the flags differ on less than ``limit`` of the rows, else leaves the frame."""
    share = flag_agreement(df, a, b).first()["disagreement"]
    if share is None or share >= limit:
        return df
    return df.withColumn(out, (F.coalesce(F.col(a) == 1, F.lit(False)) & F.coalesce(F.col(b) == 1, F.lit(False))).cast("int"))


def land_cover_groups(df: DataFrame, cls: str, groups: dict[str, tuple[int, ...]] = GROUPS_6) -> DataFrame:
    return df.select("*", *one_hot(F.col(cls), groups))


def group_fractions(df: DataFrame, groups: dict[str, tuple[int, ...]] = GROUPS_6, prefix: str = "lc_") -> DataFrame:
    """One row: share of rows in each group, and ``most`` (1 at most: the groups exclude each other)."""
    names = [f"{prefix}{g}" for g in groups]
    return df.agg(*[F.avg(n).alias(n) for n in names], F.max(sum((F.col(n) for n in names[1:]), F.col(names[0]))).alias("most"))


def pad_last_year(df: DataFrame, year: str, target: int) -> DataFrame:
    """If the last year lies before ``target``, its rows once more, stamped ``target`` (years between stay empty)."""
    last = df.agg(F.max(year)).first()[0]
    if last is None or last >= target:
        return df
    return df.unionByName(df.filter(F.col(year) == last).withColumn(year, F.lit(target).cast(df.schema[year].dataType)))


def coordinate_norms(cells: DataFrame, y: str = "y", x: str = "x", names: tuple[str, str] = ("lat_norm", "lon_norm")) -> DataFrame:
    """Cells with both coordinates scaled to 0..1 over all of them (projected or geographic alike)."""
    r = cells.agg(F.min(y), F.max(y), F.min(x), F.max(x)).first()
    if r[0] is None:
        return cells.withColumns({n: F.lit(None).cast("double") for n in names})
    return cells.withColumns({names[0]: min_max(F.col(y), r[0], r[1]), names[1]: min_max(F.col(x), r[2], r[3])})
