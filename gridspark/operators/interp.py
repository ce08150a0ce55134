"""Station values onto grid nodes and fine cells: neighbour tables, two-pass Barnes analysis, inverse-distance weighting
in log space, bilinear refinement, bounded gap filling.

Distances don't depend on the day, so the neighbour table is built once, by a bucketed equi-join. Targets are cut into
blocks a few radii wide and days into stretches; per block and stretch the neighbours make one weight matrix, the
observations another, and their product gives all values at once. So what is shuffled is the neighbour table and the
observations, never their product.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions.geo import euclidean
from gridspark.functions.missing import finite
from gridspark.operators.grid import Grid

BARNES_RADIUS_KM, IDW_RADIUS_KM = 150.0, 50.0
MIN_NEIGHBOURS = 3
GAMMA = 0.3
DRIZZLE = 0.1


def kappa(spacing: float, e: float = 1.0, factor: float = 1.33) -> float:
    """Smoothing parameter for a mean station spacing: (factor * spacing)^2 / (4 e)."""
    return (factor * spacing) ** 2 / (4 * e)


BARNES_KAPPA = kappa(19.0, 0.5)


def radius_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "x", ry: str = "y") -> DataFrame:
    """Pairs at most ``radius`` apart with ``d2``, the squared distance; columns of the two sides must differ.

    Both sides are cut into squares of the radius; the right side goes to its square and the eight around, so the
    join is an equi-join on the square and every pair is met once.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    a = left.withColumns({"__bx": bucket(lx), "__by": bucket(ly)})
    near = F.explode(F.array(*[F.struct((bucket(rx) + i).alias("__bx"), (bucket(ry) + j).alias("__by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = right.withColumn("__b", near).select("*", "__b.__bx", "__b.__by").drop("__b")
    if lx == rx:
        b = b.withColumnsRenamed({rx: f"__r_{rx}", ry: f"__r_{ry}"})
        rx, ry = f"__r_{rx}", f"__r_{ry}"
    d2 = F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2)
    return a.join(b, ["__bx", "__by"]).withColumn("d2", d2).filter(F.col("d2") <= float(radius) ** 2).drop("__bx", "__by", *(c for c in (rx, ry) if c.startswith("__r_")))


def nearest_spacing(df: DataFrame, key: str, x: str, y: str, k: int = 1, levels: int = 12) -> DataFrame:
    """``key, spacing``: mean distance to the k nearest points of other keys, for any k and spread of points.

    Squares of ``levels`` sizes, each a quarter as wide as the last, are counted; a point looks as far as the diagonal of
    the smallest square around it that holds k other keys, which is far enough, and one equi-join on the squares of
    each size gives all candidates: few where points are dense, and no round is ever repeated. Points of the same
    position have distance 0 from each other; with fewer than k other keys all of them count, with none it is NULL.
    """
    pts = df.filter(F.col(key).isNotNull() & finite(F.col(x)) & finite(F.col(y))).select(F.col(key).alias("k1"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()
    r = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count_distinct("k1")).first()
    need = min(k, (r[4] or 0) - 1)
    if need < 1:
        return pts.select(F.col("k1").alias(key), F.lit(None).cast("double").alias("spacing")).distinct()
    wide = max(r[1] - r[0], r[3] - r[2]) * (1 + 1e-9) or 1.0
    side = F.lit(wide) / F.pow(F.lit(4.0), F.col("l"))
    square = {"bx": F.floor((F.col("x") - r[0]) / side), "by": F.floor((F.col("y") - r[2]) / side)}
    every = pts.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumns(square)
    full = every.groupBy("l", "bx", "by").agg(F.count_distinct("k1").alias("n")).filter(F.col("n") > need)
    own = every.join(full, ["l", "bx", "by"]).groupBy("k1", "x", "y").agg(F.max("l").alias("l"))
    # one square of twice that side holds the diagonal on every side
    double = {"bx": F.floor((F.col("x") - r[0]) / (2 * side)), "by": F.floor((F.col("y") - r[2]) / (2 * side))}
    a = own.withColumns(double).withColumn("b", F.explode(F.array(*[F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    a = a.select("k1", "x", "y", "l", "b.bx", "b.by")
    used = own.select("l").distinct()
    other = pts.crossJoin(F.broadcast(used)).withColumns(double).select(F.col("k1").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "l", "bx", "by")
    pairs = a.join(other, ["l", "bx", "by"]).filter(F.col("k1") != F.col("k2")).withColumn("far", euclidean(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    if need == 1:
        near = pairs.groupBy("k1").agg(F.min("far").alias("spacing"))
    else:
        rank = F.row_number().over(Window.partitionBy("k1").orderBy("far"))
        near = pairs.groupBy("k1", "k2").agg(F.min("far").alias("far")).withColumn("rank", rank).filter(F.col("rank") <= need).groupBy("k1").agg(F.avg("far").alias("spacing"))
    return near.withColumnRenamed("k1", key)


def spacing_summary(df: DataFrame, spacing: str = "spacing") -> DataFrame:
    """One row: n, mean, median, population deviation, deciles and quartiles (linear), maximum."""
    p = F.percentile(F.col(spacing), F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    d = df.agg(F.count(spacing).alias("n"), F.avg(spacing).alias("mean"), F.stddev_pop(spacing).alias("std"), p.alias("p"), F.max(spacing).alias("max"))
    return d.select("n", "mean", "std", *[F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))], "max")


def neighbours(nodes: DataFrame, stations: DataFrame, radius: float) -> DataFrame:
    """``iy, ix, station_id, d2`` of nodes (``iy, ix, x, y``) and stations (``station_id, x, y``)."""
    return radius_join(nodes.select("iy", "ix", "x", "y"), stations.select("station_id", "x", "y"), radius).select("iy", "ix", "station_id", "d2")


#: days of a stretch, width of a block of targets in radii, targets whose weights are held at once
STRETCH, BLOCK_RADII, AT_ONCE = 128, 4, 256


def _by_matrix(obs: DataFrame, values: Sequence[str], stations: DataFrame, targets: DataFrame, keys: Sequence[str], radius: float,
               compute: Callable[[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``date, keys, value`` at targets (``keys, x, y``) from observations (``date, station_id`` and ``values``).

    ``compute(near, d2, v, rank)`` gets, for some targets of a block and the days of a stretch, which stations are within
    the radius (targets x stations) and how far, per value the (stations x days) matrix with NaN for missing, and the
    stations' order by id; it gives (values, which of them there are), targets x days.
    """
    keys, values = list(keys), list(values)
    side = F.lit(float(radius * BLOCK_RADII))
    t = targets.select(*keys, "x", "y").withColumns({"__tx": F.floor(F.col("x") / side), "__ty": F.floor(F.col("y") / side)})
    s = stations.select(F.col("station_id").alias("__s"), "x", "y")
    near = radius_join(t, s, radius).select("__tx", "__ty", *keys, "__s", "d2")
    epoch = F.lit("1970-01-01").cast("date")
    o = obs.withColumns({"__d": F.datediff("date", epoch)}).withColumn("__q", F.floor(F.col("__d") / STRETCH).cast("int"))
    spots = near.select("__tx", "__ty", "__s").distinct().toDF("__ox", "__oy", "__s")
    o = o.withColumnRenamed("station_id", "__s").join(spots, "__s").select("__ox", "__oy", F.col("__q").alias("__oq"), "__d", "__s", *values)
    stretches = obs.select(F.floor(F.datediff("date", epoch) / STRETCH).cast("int").alias("__q")).distinct()  # of the calendar's size
    near = near.crossJoin(F.broadcast(stretches))
    kinds = {f.name: f.dataType.simpleString() for f in targets.select(*keys).schema}

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("__d", *keys, "value")})
        if a.empty or b.empty:
            return empty
        ids = np.unique(a["__s"].to_numpy())
        days, day = np.unique(a["__d"].to_numpy(), return_inverse=True)
        station = np.searchsorted(ids, a["__s"].to_numpy())
        v = []
        for c in values:
            m = np.full((len(ids), len(days)), np.nan)
            m[station, day] = a[c].to_numpy(float)
            v.append(m)
        b = b[b["__s"].isin(ids)]
        target, names = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy(), b[keys].drop_duplicates()
        col, d2 = np.searchsorted(ids, b["__s"].to_numpy()), b["d2"].to_numpy(float)
        order = np.argsort(target, kind="stable")
        target, col, d2 = target[order], col[order], d2[order]
        parts = []
        for first in range(0, len(names), AT_ONCE):
            n = min(AT_ONCE, len(names) - first)
            lo, hi = np.searchsorted(target, [first, first + n])
            here, far = np.zeros((n, len(ids)), bool), np.zeros((n, len(ids)))
            here[target[lo:hi] - first, col[lo:hi]], far[target[lo:hi] - first, col[lo:hi]] = True, d2[lo:hi]
            out, ok = compute(here, far, v, np.arange(len(ids)))
            i, j = np.nonzero(ok)
            parts.append(pd.DataFrame({"__d": days[j], **{k: names[k].to_numpy()[first + i] for k in keys}, "value": out[i, j]}))
        return pd.concat(parts) if parts else empty

    done = o.groupBy("__ox", "__oy", "__oq").cogroup(near.groupBy("__tx", "__ty", "__q")).applyInPandas(block, "__d int, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", value double")
    return done.select(F.date_from_unix_date("__d").alias("date"), *keys, "value")


def _mean(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weighted means, sums of weights) of the valid values, targets x days."""
    ok = ~np.isnan(v)
    den = w @ ok
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, (w @ np.where(ok, v, 0.0)) / den, np.nan), den


def barnes(obs: DataFrame, stations: DataFrame, nodes: DataFrame, radius: float = BARNES_RADIUS_KM, k: float = BARNES_KAPPA, gamma: float = GAMMA, min_neighbours: int = MIN_NEIGHBOURS, passes: int = 2) -> DataFrame:
    """``date, iy, ix, value`` of observations (``date, station_id, value``): Gaussian means of the stations within the
    radius, corrected in a second pass by the sharper-weighted residuals at the stations.

    A node needs ``min_neighbours`` valid stations that day; stations need none for their first guess. Repeated
    (date, station_id) rows count once, with the largest value.
    """
    o = obs.filter(finite(F.col("value")) & F.col("date").isNotNull()).groupBy("date", "station_id").agg(F.max(F.col("value").cast("double")).alias("v"))
    # distances only between what is ever observed and what is asked for
    stations = stations.join(o.select("station_id").distinct(), "station_id", "left_semi").select("station_id", "x", "y")

    def first(near: np.ndarray, d2: np.ndarray, v: list[np.ndarray], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        guess, den = _mean(np.where(near, np.exp(-d2 / k), 0.0), v[0])
        return guess, near.astype(float) @ ~np.isnan(v[0]) >= least

    def both(near: np.ndarray, d2: np.ndarray, v: list[np.ndarray], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        guess, den = _mean(np.where(near, np.exp(-d2 / k), 0.0), v[0])
        more, _ = _mean(np.where(near, np.exp(-d2 / (gamma * k)), 0.0), v[1])
        return guess + np.nan_to_num(more), near.astype(float) @ ~np.isnan(v[0]) >= min_neighbours

    least = min_neighbours
    if passes == 1:
        g = _by_matrix(o, ["v"], stations, nodes, ["iy", "ix"], radius, first)
        return g.select("date", "iy", "ix", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    least = 1
    at = _by_matrix(o, ["v"], stations, stations.withColumnRenamed("station_id", "s1"), ["s1"], radius, first).select("date", F.col("s1").alias("station_id"), F.col("value").alias("guess"))
    r = o.join(at, ["date", "station_id"], "left").withColumn("r", F.coalesce(F.col("v") - F.nanvl("guess", F.lit(None).cast("double")), F.lit(0.0)))
    g = _by_matrix(r, ["v", "r"], stations, nodes, ["iy", "ix"], radius, both)
    return g.select("date", "iy", "ix", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def idw_log(obs: DataFrame, stations: DataFrame, nodes: DataFrame, radius: float = IDW_RADIUS_KM, min_neighbours: int = MIN_NEIGHBOURS, drizzle: float = DRIZZLE) -> DataFrame:
    """``date, iy, ix, value``: inverse-square-distance mean of log1p; a node on a station takes its value (that of the
    smallest station id), results below ``drizzle`` are 0. Negative and missing values don't count; repeated
    (date, station_id) rows count once, with the largest value."""
    o = obs.filter(finite(F.col("value")) & (F.col("value") >= 0) & F.col("date").isNotNull()).groupBy("date", "station_id").agg(F.max(F.log1p(F.col("value").cast("double"))).alias("lv"))
    stations = stations.join(o.select("station_id").distinct(), "station_id", "left_semi")

    def compute(near: np.ndarray, d2: np.ndarray, v: list[np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            out, _ = _mean(np.where(near & (d2 > 0), 1 / d2, 0.0), v[0])
        on = near & (d2 == 0)
        for i in np.nonzero(on.any(1))[0]:
            for j in rank[on[i]][::-1]:  # the smallest id is written last
                out[i] = np.where(np.isnan(v[0][j]), out[i], v[0][j])
        out = np.expm1(out)
        return np.where(out < drizzle, 0.0, out), near.astype(float) @ ~np.isnan(v[0]) >= min_neighbours

    g = _by_matrix(o, ["lv"], stations, nodes, ["iy", "ix"], radius, compute)
    return g.select("date", "iy", "ix", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def bilinear(values: DataFrame, coarse: Grid, fine: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """``keys, iy, ix, value`` on the fine cells (``iy, ix, x, y``) from coarse nodes (``keys, iy, ix, value``).

    Cells outside the nodes' hull, or with a missing corner, come out NULL (for the days that have any node). A day's
    coarse nodes are narrow and join on the corner's key; every coarse node meets only the cells around it.
    """
    keys = list(keys)
    tx, ty = (F.col("x") - coarse.x0) / coarse.res, (F.col("y") - coarse.y0) / coarse.res
    f = fine.select("iy", "ix", tx.alias("__tx"), ty.alias("__ty"))
    f = f.filter(F.col("__tx").between(0, coarse.nx - 1) & F.col("__ty").between(0, coarse.ny - 1))
    f = f.withColumns({"__i": F.least(F.floor("__tx"), F.lit(max(coarse.nx - 2, 0))).cast("int"), "__j": F.least(F.floor("__ty"), F.lit(max(coarse.ny - 2, 0))).cast("int")})
    t, u = F.col("__tx") - F.col("__i"), F.col("__ty") - F.col("__j")
    corner = [F.struct((F.col("__j") + j).alias("cy"), (F.col("__i") + i).alias("cx"), ((u if j else 1 - u) * (t if i else 1 - t)).alias("w")) for j in (0, 1) for i in (0, 1)]
    f = f.select("iy", "ix", F.explode(F.array(*corner)).alias("c")).select("iy", "ix", "c.cy", "c.cx", "c.w")
    c = values.select(*keys, F.col("iy").alias("cy"), F.col("ix").alias("cx"), "value")
    return f.join(c, ["cy", "cx"]).groupBy(*keys, "iy", "ix").agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("value"))


def fill_gaps(df: DataFrame, value: str, line: Sequence[str], axis: str, max_gap: float, coordinate: str | None = None) -> DataFrame:
    """Linear fill along ``axis`` within each ``line``; a gap is as long as the distance between the valid values on its
    sides (in indices, or in ``coordinate``), longer ones and those at the ends stay. Adds ``value`` in place."""
    pos = F.col(coordinate or axis).cast("double")
    here = F.when(finite(F.col(value)), F.struct(pos.alias("p"), F.col(value).cast("double").alias("v")))
    w = Window.partitionBy(*line).orderBy(axis)
    a = F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumns({"__a": a, "__b": b})
    a, b = F.col("__a"), F.col("__b")
    run = b["p"] - a["p"]
    filled = F.when(run <= max_gap, a["v"] + (b["v"] - a["v"]) * (pos - a["p"]) / F.nullif(run, F.lit(0.0)))
    return d.withColumn(value, F.coalesce(F.when(finite(F.col(value)), F.col(value).cast("double")), filled)).drop("__a", "__b")


def fill_gaps_2d(df: DataFrame, value: str, max_gap: float = 10, time: Sequence[str] = ("time",), units: str = "cells") -> DataFrame:
    """Along x, then along y on the result. ``units``: gaps in ``cells`` or in ``coord`` (columns x, y)."""
    x, y = (None, None) if units == "cells" else ("x", "y")
    d = fill_gaps(df, value, [*time, "iy"], "ix", max_gap, x)
    return fill_gaps(d, value, [*time, "ix"], "iy", max_gap, y)
