"""Irregular readings onto a regular grid of periods, by compact-kernel weighted local polynomial regression.

A period's estimate is the value at its midpoint of a line fitted to all readings within ``h`` days of it, weighted
by the kernel ``1 - (dt / h)^2``. The fit needs six sums per (source, period), so it is one aggregate: every reading
is handed to the periods of the days from ``t - h`` to ``t + h``, short last periods of a year among them, and summed
there. Nothing is ever gathered per source: the work is spread over (source, block of
``BLOCK`` periods), readings near a block's edge go to both blocks, and within a block the sums are built by
streaming hash aggregates. One shuffle carries the narrow readings; de-duplication, fan-out and fit need none.

Sources that hold more than ``HOT_SHARE`` of all rows (so at most ``1 / HOT_SHARE`` of them) take another way to the same
sums: repeated readings are merged by a partial aggregate spread over (source, time), then readings that touch the same
periods are reduced, also by a partial aggregate, to their moments, of which the kernel's sums are combinations. What is
left of a hot source grows with its calendar, not with its readings.

Periods start on days 1, 5, 9, ... of each year and last four days, the last of a year ends with the year.

Defined results: rows without a time are ignored; a NULL source key is a source of its own; readings whose value
is NULL, NaN or infinite, or whose flag is not 1, only stretch the source's range of periods; rows that repeat
(source, time) count once, with the largest valid value; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import finite

PER_YEAR = 92
BLOCK = 23
HALF_WIDTH_DAYS = 14.0
#: periods on either side that the default kernel may touch, one of them the short last one of a year
REACH = math.ceil(HALF_WIDTH_DAYS / 4) + 1
MIN_SUPPORT = 1.5
HOT_SHARE = 1 / 200


def period_of(time: Column) -> Column:
    """Running number of the 4-day period: 92 a year, leap or not."""
    day = F.to_date(time)
    return (F.year(day) * PER_YEAR + F.floor((F.dayofyear(day) - 1) / 4)).cast("int")


def period_start(period: Column) -> Column:
    year = F.floor(period / PER_YEAR).cast("int")
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), ((period - year * PER_YEAR) * 4).cast("int"))


def period_middle(period: Column) -> Column:
    """Midpoint of the period in days since 1970."""
    year = F.floor(period / PER_YEAR).cast("int")
    start = period_start(period)
    end = F.least(F.date_add(start, 4), F.make_date(year + 1, F.lit(1), F.lit(1)))
    epoch = F.lit("1970-01-01").cast("date")
    return (F.datediff(start, epoch) + F.datediff(end, epoch)) / F.lit(2.0)


def days_since_epoch(time: Column) -> Column:
    day = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    return day + (F.hour(time) * 3600 + F.minute(time) * 60 + F.date_part(F.lit("SECOND"), time).cast("double")) / F.lit(86400.0)


def reached(t: Column, half_width: float) -> tuple[Column, Column]:
    """First and last period whose midpoint can lie within ``half_width`` days of ``t`` (days since 1970)."""
    day = lambda x: F.date_add(F.lit("1970-01-01").cast("date"), F.floor(x).cast("int"))
    return period_of(day(t - F.lit(float(half_width)))), period_of(day(t + F.lit(float(half_width))))


_SUMS = ("s0", "s1", "s2", "ww", "r0", "r1")


def _block(p: Column) -> Column:
    return F.floor(p / BLOCK).cast("int")


def _span(d: DataFrame, source: list[str]) -> DataFrame:
    return d.groupBy(*source).agg(F.min("__q").alias("__lo"), F.max("__q").alias("__hi"))


def hot_sources(d: DataFrame, source: list[str], share: float) -> DataFrame | None:
    """Sources with more than ``share`` of the rows, under the names ``__s0, __s1, ...``: at most ``1 / share`` rows."""
    rows = d.groupBy(*source).count().filter(F.col("count") > share * d.count()).select(*source)
    got = rows.collect()
    return d.sparkSession.createDataFrame(got, rows.schema).toDF(*[f"__s{i}" for i in range(len(source))]) if got else None


def _sums_by_block(d: DataFrame, source: list[str], half_width: float) -> DataFrame:
    """The kernel's sums of each (source, period), readings spread over blocks of periods."""
    first, last = reached(F.col("__t"), half_width)
    no_int, no_y = F.lit(None).cast("int"), F.lit(None).cast("double")
    readings = (d.filter(F.col("__y").isNotNull()).withColumn("__t", days_since_epoch(F.col("__time")))
                .withColumn("__b", F.explode(F.sequence(_block(first), _block(last))))
                .select(*source, "__b", "__q", "__t", "__y", no_int.alias("__lo"), no_int.alias("__hi")))
    marks = (_span(d, source).withColumn("__b", F.explode(F.sequence(_block(F.col("__lo")), _block(F.col("__hi")))))
             .select(*source, "__b", no_int.alias("__q"), no_y.alias("__t"), no_y.alias("__y"), "__lo", "__hi"))
    both = readings.unionByName(marks).repartition(*source, "__b")
    once = both.groupBy(*source, "__b", "__q", "__t").agg(F.max("__y").alias("__y"), F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    mark = F.col("__q").isNull()
    a, b = F.col("__b") * BLOCK, F.col("__b") * BLOCK + BLOCK - 1
    reach = F.sequence(F.greatest(F.when(mark, F.col("__lo")).otherwise(first), a), F.least(F.when(mark, F.col("__hi")).otherwise(last), b))
    fan = once.withColumn("period", F.explode(reach))
    fan = fan.withColumn("__x", (F.col("__t") - period_middle(F.col("period"))) / F.lit(float(half_width)))
    fan = fan.withColumn("__w", F.greatest(F.lit(1.0) - F.col("__x") * F.col("__x"), F.lit(0.0)))
    w, x, y = F.col("__w"), F.col("__x"), F.col("__y")
    g = fan.groupBy(*source, "__b", "period").agg(
        F.max(mark.cast("int")).alias("__spine"), F.sum((F.col("__q") == F.col("period")).cast("long")).alias("__n"),
        F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * w).alias("ww"), F.sum(w * y).alias("r0"), F.sum(w * x * y).alias("r1"))
    return g.filter(F.col("__spine") == 1).drop("__b", "__spine")


def _sums_by_moments(d: DataFrame, source: list[str], half_width: float) -> DataFrame:
    """The same sums by way of moments: for few sources, each with any number of readings."""
    h = F.lit(float(half_width))
    first, last = reached(F.col("__t"), half_width)
    once = (d.filter(F.col("__y").isNotNull()).withColumn("__t", days_since_epoch(F.col("__time")))
            .groupBy(*source, "__q", "__t").agg(F.max("__y").alias("__y")).withColumns({"__a": first, "__z": last}))
    # exactly the periods whose kernel holds the reading: all readings of a cell (q, a, z) share them
    once = once.withColumns({"__a": F.when(F.abs(F.col("__t") - period_middle(F.col("__a"))) >= h, F.col("__a") + 1).otherwise(F.col("__a")),
                             "__z": F.when(F.abs(F.col("__t") - period_middle(F.col("__z"))) >= h, F.col("__z") - 1).otherwise(F.col("__z"))})
    once = once.withColumn("__u", (F.col("__t") - period_middle(F.col("__q"))) / h)
    power = lambda k: F.pow(F.col("__u"), F.lit(float(k))) if k else F.lit(1.0)
    cells = once.groupBy(*source, "__q", "__a", "__z").agg(*[F.sum(power(k)).alias(f"__m{k}") for k in range(5)], *[F.sum(power(k) * F.col("__y")).alias(f"__y{k}") for k in range(4)])
    fan = cells.withColumn("period", F.explode(F.when(F.col("__a") <= F.col("__z"), F.sequence("__a", "__z"))))
    fan = fan.withColumn("__e", (period_middle(F.col("__q")) - period_middle(F.col("period"))) / h)

    def moved(name: str, k: int) -> Column:
        """Moment ``k`` about the period's midpoint from those about the middle of the readings' own period."""
        return sum((F.lit(float(math.comb(k, j))) * F.pow(F.col("__e"), F.lit(float(k - j))) * F.col(f"__{name}{j}") for j in range(k)), F.col(f"__{name}{k}"))

    fan = fan.select(*source, "period", F.when(F.col("__q") == F.col("period"), F.col("__m0")).otherwise(F.lit(0.0)).cast("long").alias("__n"),
                     *[moved("m", k).alias(f"m{k}") for k in range(5)], *[moved("y", k).alias(f"y{k}") for k in range(4)])
    m, y = [F.col(f"m{k}") for k in range(5)], [F.col(f"y{k}") for k in range(4)]
    sums = dict(zip(_SUMS, (m[0] - m[2], m[1] - m[3], m[2] - m[4], m[0] - 2 * m[2] + m[4], y[0] - y[2], y[1] - y[3])))
    rows = fan.select(*source, "period", "__n", m[0].alias("__k"), *[c.alias(n) for n, c in sums.items()], F.lit(0).alias("__spine"))
    spine = _span(d, source).select(*source, F.explode(F.sequence("__lo", "__hi")).alias("period"), F.lit(0).cast("long").alias("__n"), F.lit(0.0).alias("__k"), *[F.lit(0.0).alias(n) for n in _SUMS], F.lit(1).alias("__spine"))
    g = rows.unionByName(spine).groupBy(*source, "period").agg(F.max("__spine").alias("__spine"), F.sum("__n").alias("__n"), F.sum("__k").alias("__k"), *[F.sum(n).alias(n) for n in _SUMS])
    # k readings have a sum of squared weights between s0^2 / k and s0^2, whatever rounding makes of tiny weights
    square = F.col("s0") * F.col("s0")
    ww = F.when(F.col("__k") > 0.5, F.least(F.greatest("ww", square / F.col("__k")), square)).otherwise(F.lit(0.0))
    return g.filter(F.col("__spine") == 1).withColumn("ww", ww).drop("__spine", "__k")


def regular_grid(df: DataFrame, source: Sequence[str], time: str, value: str, flag: str | None = None,
                 half_width: float = HALF_WIDTH_DAYS, min_support: float = MIN_SUPPORT, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per source and period from its first to its last row.

    Columns: the source's, ``period INT, period_start DATE, value DOUBLE`` (the fit, NULL where missing),
    ``n_readings BIGINT`` (valid readings of the period itself), ``support DOUBLE`` (effective number of readings,
    ``(sum w)^2 / sum w^2``) and ``mark`` (``observed``, ``filled`` or ``missing``). A period without a valid
    reading is filled where the support reaches ``min_support``, else missing.
    """
    source = list(source)
    valid = finite(F.col(value)) if flag is None else finite(F.col(value)) & F.coalesce(F.col(flag) == 1, F.lit(False))
    d = df.filter(F.col(time).isNotNull()).select(*source, F.col(time).alias("__time"), F.when(valid, F.col(value).cast("double")).alias("__y"))
    d = d.withColumn("__q", period_of(F.col("__time")))
    hot = hot_sources(d, source, hot_share)
    if hot is None:
        g = _sums_by_block(d, source, half_width)
    else:
        same = F.lit(True)
        for i, c in enumerate(source):
            same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
        g = _sums_by_block(d.join(F.broadcast(hot), same, "left_anti"), source, half_width).unionByName(_sums_by_moments(d.join(F.broadcast(hot), same, "left_semi"), source, half_width))
    n = F.coalesce("__n", F.lit(0).cast("long"))
    support = F.when(F.col("ww") > 0, F.col("s0") * F.col("s0") / F.col("ww")).otherwise(F.lit(0.0))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("r0") - F.col("s1") * F.col("r1")) / F.nullif(det, F.lit(0.0))
    level = F.col("r0") / F.nullif(F.col("s0"), F.lit(0.0))
    known = (n > 0) | (support >= min_support)
    fit = F.when(det > F.col("s0") * F.col("s0") * 1e-3, line).otherwise(level)
    name = F.when(n > 0, F.lit("observed")).when(known, F.lit("filled")).otherwise(F.lit("missing"))
    return g.select(*source, "period", period_start(F.col("period")).alias("period_start"), F.when(known, fit).alias("value"), n.alias("n_readings"), support.alias("support"), name.alias("mark"))
