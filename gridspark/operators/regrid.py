"""Fine pixels onto grid cells: quality mask, mean and majority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import finite, nan_to_null

#: fixed values of the quality layers: significant clouds were present
QC_CLOUDY = (8, 10, 40, 42, 73, 75, 105, 107)
#: fixed values of the extra quality layer that count as land
QC_LAND = (0, 4, 8, 12, 32, 36, 48, 52, 64, 68, 72, 76, 128, 132, 136, 140, 160, 164, 176, 180, 192, 196, 200, 204)


def qc_mask(value: Column, qc: Column, extra: Column, cloudy: Sequence[int] = QC_CLOUDY, land: Sequence[int] = QC_LAND) -> Column:
    """The value where the pixel is neither cloudy nor off land; a missing ``qc`` passes, a missing ``extra`` doesn't."""
    keep = ~F.coalesce(qc.isin(*cloudy), F.lit(False)) & F.coalesce(extra.isin(*land), F.lit(False))
    return F.when(keep, value)


def bucket_mean(df: DataFrame, keys: Sequence[str], value: str, cells: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Mean of the valid values per cell; with ``cells`` every cell comes out, empty ones NULL."""
    out = out or value
    g = df.groupBy(*keys).agg(F.avg(nan_to_null(F.col(value).cast("double"))).alias(out))
    return g if cells is None else cells.join(g, list(keys), "left")


def bucket_mode(df: DataFrame, keys: Sequence[str], value: str, cells: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Most frequent valid value per cell, the smallest of equally frequent ones.

    Two partial aggregates: counts per (cell, value), then the best count per cell. No window, no sort.
    """
    out = out or value
    counts = df.filter(finite(F.col(value))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    g = counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(out))
    return g if cells is None else cells.join(g, list(keys), "left")
