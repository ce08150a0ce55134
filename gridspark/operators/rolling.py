"""Rolling totals over trailing periods of calendar days, days without activity included.

Entities by days are packed into dense numpy blocks: each row of a block is one entity in one time tile, its
columns are the tile's days with the preceding halo days before them. A window of W days is a banded 0/1 matrix;
totals and counts of all entities and days of a block are two matrix products. An entity's tile needs only the
rows of that tile and of the ``max(windows) - 1`` days before it, so tiles are independent: they are spread over
the cluster by (entity, tile), and no entity, however long its history, lands in one task.

Rows that repeat an (entity, day) are the same reading: they are merged (largest valid value) by a partial
aggregate before anything else is shuffled.

Defined results: rows with a NULL day are ignored; a NULL entity key is an entity of its own; a NULL, NaN or
infinite value is a day without a value; an empty table gives an empty result; a day's ``total_W`` is 0.0 and
``mean_W`` NULL where no day of the window has a value; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import nan_to_null
from gridspark.operators.grouped import whole_groups

TILE_DAYS = 128


def band(window: int, halo: int, tile: int) -> np.ndarray:
    """(halo + tile) x tile matrix; column j sums the ``window`` days that end on the tile's day j."""
    i, j = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return ((i <= j) & (i > j - window)).astype(np.float64)


def rolling_totals(df: DataFrame, entity: Sequence[str], day: str, value: Column, windows: Sequence[int], carry: dict[str, Column] | None = None, tile: int = TILE_DAYS) -> DataFrame:
    """One row per entity and calendar day from its first to its last row.

    ``value`` is the day's amount (an expression, NULL where missing); ``carry`` names aggregate expressions over
    the rows of a day that come out beside the totals (double, NULL on days without a row).

    Columns: the entity's, ``day DATE, has_row BOOLEAN, value DOUBLE``, then ``total_W, n_W, mean_W`` per window,
    then the carried ones.
    """
    carry = carry or {}
    entity, windows = list(entity), sorted(set(windows))
    halo = max(windows) - 1
    if halo > tile:
        tile = halo
    epoch = F.lit("1970-01-01").cast("date")
    d = df.filter(F.col(day).isNotNull()).withColumn("__d", F.datediff(F.to_date(F.col(day)), epoch)).withColumn("__v", nan_to_null(value.cast("double")))
    daily = d.groupBy(*entity, "__d").agg(F.max("__v").alias("__v"), *[c.alias(f"__c{i}") for i, c in enumerate(carry.values())])
    t = F.floor(F.col("__d") / tile).cast("int")
    later = F.floor((F.col("__d") + halo) / tile).cast("int")
    rows = daily.withColumn("__t", F.explode(F.sequence(t, later))).withColumns({"__lo": F.lit(None).cast("int"), "__hi": F.lit(None).cast("int")})
    span = d.groupBy(*entity).agg(F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
    marks = span.withColumn("__t", F.explode(F.sequence(F.floor(F.col("__lo") / tile).cast("int"), F.floor(F.col("__hi") / tile).cast("int"))))
    marks = marks.withColumns({"__d": F.lit(None).cast("int"), "__v": F.lit(None).cast("double")} | {f"__c{i}": F.lit(None).cast(daily.schema[f"__c{i}"].dataType) for i in range(len(carry))})
    both = rows.unionByName(marks)
    both = both.repartition(*entity, "__t").sortWithinPartitions(*entity, "__t", F.col("__d").asc_nulls_first())
    # a NULL turns a column of integers into floats in pandas, which hold 32-bit keys exactly, but not 64-bit ones
    wide = {f.name: f.dataType for f in df.select(*entity).schema if f.dataType.simpleString() == "bigint"}
    both = both.withColumns({c: F.col(f"`{c}`").cast("string") for c in wide})
    both = both.select(*entity, "__t", "__d", "__v", "__lo", "__hi", *[f"__c{i}" for i in range(len(carry))])
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*entity).schema]
    out = ", ".join([*keys, "day int, has_row boolean, value double", *[f"total_{w} double, n_{w} int, mean_{w} double" for w in windows], *[f"`{c}` double" for c in carry]])
    bands = [(w, band(w, halo, tile)) for w in windows]
    names = list(carry)

    def block(pdf: pd.DataFrame, start: np.ndarray) -> pd.DataFrame:
        """pdf holds whole (entity, tile) groups; ``start`` is the row at which each begins (its mark, if it has one)."""
        g = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pdf))))
        first = pdf.iloc[start]
        lo, hi, t0 = first["__lo"].to_numpy(float), first["__hi"].to_numpy(float), first["__t"].to_numpy(np.int64) * tile
        at = pdf["__d"].to_numpy(float)
        real = ~np.isnan(at)
        col = (at[real] - (t0[g[real]] - halo)).astype(np.int64)
        val = pdf["__v"].to_numpy(float)[real]
        shape = (len(start), halo + tile)
        dense, seen, has = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
        ok = ~np.isnan(val)
        dense[g[real][ok], col[ok]], seen[g[real][ok], col[ok]], has[g[real], col] = val[ok], 1.0, True
        days = t0[:, None] + np.arange(tile)[None, :]
        keep = (days >= lo[:, None]) & (days <= hi[:, None])  # a group without a mark lies outside its entity's days
        e, j = np.nonzero(keep)
        res = {c: first[c].to_numpy()[e] for c in entity}
        res["day"] = days[e, j].astype(np.int32)
        res["has_row"] = has[e, j + halo]
        res["value"] = np.where(seen[e, j + halo] > 0, dense[e, j + halo], np.nan)
        for w, b in bands:
            total, n = (dense @ b)[e, j], (seen @ b)[e, j]
            res |= {f"total_{w}": total, f"n_{w}": n.astype(np.int32), f"mean_{w}": np.where(n > 0, total / np.maximum(n, 1), np.nan)}
        for i, c in enumerate(names):
            x = np.full(shape, np.nan)
            x[g[real], col] = pdf[f"__c{i}"].to_numpy(float)[real]
            res[c] = x[e, j + halo]
        return pd.DataFrame(res)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, start in whole_groups(batches, [*entity, "__t"]):
            yield block(pdf, start)

    done = both.mapInPandas(pack, out)
    nulls = {c: nan_to_null(F.col(f"`{c}`")) for c in ["value", *[f"mean_{w}" for w in windows], *names]}
    done = done.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in wide.items()})
    return done.withColumns({"day": F.date_from_unix_date("day")} | nulls)

