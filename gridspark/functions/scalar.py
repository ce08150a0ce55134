"""Normalisations, flags and encodings as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: land-cover classes of each one-hot group; classes in no group are all-zero
GROUPS_6 = {"ev_trees": (1, 2), "dc_trees": (3, 4), "shrub": (5,), "grass": (6,), "c_crop": (7,), "b_crop": (8,)}
#: coarser preset; what is in no group, missing included, is "others"
GROUPS_5 = {"trees": (1, 2, 3, 4), "shrubs": (5,), "grass": (6,), "crops": (7, 8)}


def zscore(v: Column, mean: float | Column, std: float | Column) -> Column:
    """(v - mean) / std; NULL where the deviation is 0."""
    m, s = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, std))
    return (v - m) / F.nullif(s, F.lit(0.0))


def log_zscore(v: Column, mean: float | Column, std: float | Column) -> Column:
    return zscore(F.log1p(v), mean, std)


def log_zscore_inverse(n: Column, mean: float, std: float) -> Column:
    return F.expm1(n * std + mean)


def masked_zscore(v: Column, flag: Column, mean: float | Column, std: float | Column) -> Column:
    """z-score where the flag is 1, else 0."""
    return F.when(F.coalesce(flag == 1, F.lit(False)), F.coalesce(zscore(v, mean, std), F.lit(0.0))).otherwise(F.lit(0.0))


def min_max(v: Column, low: float | Column, high: float | Column) -> Column:
    """``v`` scaled so that low is 0 and high is 1; NULL where they are equal."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return (v - low) / F.nullif(high - low, F.lit(0.0))


def doy_encoding(day: Column) -> tuple[Column, Column]:
    """(sine, cosine) of the day of year on a circle of 365 days, so day 366 falls on day 1."""
    a = F.dayofyear(day) * (2 * math.pi / 365)
    return F.sin(a), F.cos(a)


def one_hot(cls: Column, groups: dict[str, tuple[int, ...]] = GROUPS_6, prefix: str = "lc_", others: str | None = None) -> list[Column]:
    """One 0/1 column per group; a missing class belongs to none (or to ``others`` where asked for)."""
    cols = [F.coalesce(cls.isin(*members), F.lit(False)).cast("int").alias(f"{prefix}{name}") for name, members in groups.items()]
    if others:
        all_members = [m for members in groups.values() for m in members]
        cols.append((~F.coalesce(cls.isin(*all_members), F.lit(False))).cast("int").alias(f"{prefix}{others}"))
    return cols


def cast_by_name(df: DataFrame, keys: tuple[str, ...] = ("time", "iy", "ix")) -> DataFrame:
    """Flags (``_flag`` in the name) become small integers, other variables floats; keys stay."""
    def kind(c: str) -> Column:
        if c in keys:
            return F.col(f"`{c}`")
        return F.col(f"`{c}`").cast("tinyint" if "_flag" in c else "float").alias(c)

    return df.select([kind(c) for c in df.columns])


def to_half(v: Column) -> Column:
    """``v`` rounded to what a 16-bit float can hold, as float (half precision has 11 significant bits).

    Overflow becomes infinity, values below the smallest subnormal 0; NULL stays NULL.
    """
    x = v.cast("double")
    mag = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.when(mag > 0, mag))), F.lit(-14))
    step = F.pow(F.lit(2.0), exponent - 10)
    near = F.rint(x / step) * step
    return F.when(x.isNull(), F.lit(None)).when(mag == 0, x).when(F.abs(near) > 65504.0, F.signum(x) * float("inf")).otherwise(near).cast("float")
