"""Errors of predictions on valid pixels only (flag 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _error(pred: str, true: str, flag: str) -> Column:
    return F.when(F.col(flag) == 1, F.col(pred).cast("double") - F.col(true).cast("double"))


def masked_mse(df: DataFrame, pred: str = "pred", true: str = "true", flag: str = "flag") -> DataFrame:
    """One row ``mse``; 0 where nothing is valid."""
    e = _error(pred, true, flag)
    return df.agg(F.coalesce(F.avg(e * e), F.lit(0.0)).alias("mse"))


def masked_metrics(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", true: str = "true", flag: str = "flag") -> DataFrame:
    """``mse, mae, rmse, n_valid``, for each group of ``by``; zeros where nothing is valid."""
    e = _error(pred, true, flag)
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(F.coalesce(F.avg(e * e), zero).alias("mse"), F.coalesce(F.avg(F.abs(e)), zero).alias("mae"), F.coalesce(F.sqrt(F.avg(e * e)), zero).alias("rmse"), F.count(e).alias("n_valid"))


def error_sums(df: DataFrame, by: Sequence[str] = ("lead",), pred: str = "pred", true: str = "true", flag: str = "flag") -> DataFrame:
    """Sums that add up over batches: ``sum_sq, sum_abs, n`` per group."""
    e = _error(pred, true, flag)
    return df.groupBy(*by).agg(F.coalesce(F.sum(e * e), F.lit(0.0)).alias("sum_sq"), F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("sum_abs"), F.count(e).alias("n"))


def merge_error_sums(parts: DataFrame, by: Sequence[str] = ("lead",)) -> DataFrame:
    """RMSE and MAE of error sums from any number of batches."""
    g = parts.groupBy(*by).agg(F.sum("sum_sq").alias("s"), F.sum("sum_abs").alias("a"), F.sum("n").alias("n_valid"))
    n = F.nullif("n_valid", F.lit(0))
    return g.select(*by, F.coalesce(F.sqrt(F.col("s") / n), F.lit(0.0)).alias("rmse"), F.coalesce(F.col("a") / n, F.lit(0.0)).alias("mae"), "n_valid")


def mean_of_batches(df: DataFrame, batch: str = "batch", **names: str) -> DataFrame:
    """Mean of the batches' masked errors, every batch counting the same."""
    return masked_metrics(df, [batch], **names).agg(F.avg("mse").alias("mse"), F.count("*").alias("batches"))


def parameter_count(weights: DataFrame) -> DataFrame:
    """Number of parameters of a table of weights (``name, shape, data``)."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return weights.agg(F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("parameters"))
