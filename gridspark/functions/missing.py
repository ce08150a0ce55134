"""Missing-value model: NULL is the only missing value inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """True where ``c`` is neither NULL, NaN nor infinite (never NULL)."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(c: Column) -> Column:
    """NaN and infinities become NULL; aggregates then skip them."""
    return F.when(finite(c), c)


def clean_floats(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every float and double column."""
    kinds = (T.FloatType, T.DoubleType)
    return df.select([nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])


def in_range(c: Column, low: float, high: float) -> Column:
    """``c`` as double where it is finite and within [low, high], else NULL."""
    d = c.cast("double")
    return F.when(finite(c) & d.between(low, high), d)
