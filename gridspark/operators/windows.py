"""Training windows: sliding sequences in time, square patches in space, flat sample numbers, materialised samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators.grouped import whole_groups


@dataclass(frozen=True)
class WindowSpec:
    """Sizes of a sampled cube: ``steps`` time steps of ``ny`` x ``nx`` cells."""

    steps: int
    ny: int
    nx: int
    l_in: int
    l_out: int
    stride: int = 1
    patch: int | None = None

    @property
    def length(self) -> int:
        return self.l_in + self.l_out

    @property
    def n_sequences(self) -> int:
        return max(0, (self.steps - self.length) // self.stride + 1)

    @property
    def patches(self) -> tuple[int, int]:
        """(rows, columns) of whole patches; what is left over at the upper ends is never sampled."""
        return (1, 1) if self.patch is None else (self.ny // self.patch, self.nx // self.patch)

    @property
    def n_samples(self) -> int:
        return self.n_sequences * self.patches[0] * self.patches[1]

    def sample_id(self, seq: Column, lat_patch: Column, lon_patch: Column) -> Column:
        """Flat number; the latitude patch runs fastest."""
        ny, nx = self.patches
        return seq.cast("long") * (ny * nx) + lon_patch * ny + lat_patch

    def of_sample(self, sample: Column) -> tuple[Column, Column, Column]:
        """(sequence, latitude patch, longitude patch) of a flat number."""
        ny, nx = self.patches
        rest = sample % (ny * nx)
        return F.floor(sample / (ny * nx)).cast("int"), (rest % ny).cast("int"), F.floor(rest / ny).cast("int")


def time_index(df: DataFrame, time: str = "time", out: str = "it") -> DataFrame:
    """Adds the running number of each distinct time step (a table of the calendar's size)."""
    steps = df.select(time).distinct().withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time)) - 1)
    return df.join(steps, time)


def slice_index(df: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Rows whose index columns lie in the half-open ranges, e.g. ``it=(0, 28)``."""
    for c, (a, b) in ranges.items():
        df = df.filter((F.col(c) >= a) & (F.col(c) < b))
    return df


def sequence_windows(df: DataFrame, spec: WindowSpec, it: str = "it") -> DataFrame:
    """Each time step once per window it belongs to: adds ``seq``, ``step`` (0-based) and ``role`` (``x`` or ``y``).

    A step's windows follow from its index, so this is an explode, not a range join.
    """
    i = F.col(it)
    first = F.greatest(F.ceil((i - (spec.length - 1)) / F.lit(float(spec.stride))), F.lit(0)).cast("int")
    last = F.least(F.floor(i / spec.stride), F.lit(spec.n_sequences - 1)).cast("int")
    d = df.filter(first <= last).withColumn("seq", F.explode(F.sequence(first, last)))
    step = i - F.col("seq") * spec.stride
    return d.withColumns({"step": step, "role": F.when(step < spec.l_in, F.lit("x")).otherwise(F.lit("y"))})


def add_patch(df: DataFrame, spec: WindowSpec) -> DataFrame:
    """Adds ``lat_patch, lon_patch`` and drops cells outside whole patches."""
    if spec.patch is None:
        return df.withColumns({"lat_patch": F.lit(0), "lon_patch": F.lit(0)})
    d = df.withColumns({"lat_patch": F.floor(F.col("iy") / spec.patch).cast("int"), "lon_patch": F.floor(F.col("ix") / spec.patch).cast("int")})
    return d.filter((F.col("lat_patch") < spec.patches[0]) & (F.col("lon_patch") < spec.patches[1]))


def valid_patches(df: DataFrame, spec: WindowSpec, min_fraction: float, flag: str = "LAI_flag", it: str = "it") -> DataFrame:
    """``lat_patch, lon_patch, fraction`` of patches with at least ``min_fraction`` of non-zero flags at the first step
    that has any flag 1; raises where no step has. All patches where the fraction is 0 or there are none."""
    if min_fraction <= 0 or spec.patch is None:
        ny, nx = spec.patches
        r = df.sparkSession.range(ny * nx)
        return r.select((F.col("id") % ny).cast("int").alias("lat_patch"), F.floor(F.col("id") / ny).cast("int").alias("lon_patch"), F.lit(None).cast("double").alias("fraction"))
    first = df.agg(F.min(F.when(F.col(flag) == 1, F.col(it)))).first()[0]
    if first is None:
        raise ValueError(f"no time step has {flag} = 1")
    d = add_patch(df.filter(F.col(it) == first), spec)
    g = d.groupBy("lat_patch", "lon_patch").agg(F.avg((F.coalesce(F.col(flag), F.lit(0)) != 0).cast("double")).alias("fraction"))
    return g.filter(F.col("fraction") >= min_fraction)


def sample_index(spec: WindowSpec, patches: DataFrame) -> DataFrame:
    """``sample_id, seq, seq_start, lat_patch, lon_patch`` of every sequence of every patch, in the order of the number."""
    d = patches.select("lat_patch", "lon_patch", F.explode(F.sequence(F.lit(0), F.lit(spec.n_sequences - 1))).alias("seq")) if spec.n_sequences else patches.select("lat_patch", "lon_patch", F.lit(0).alias("seq")).limit(0)
    d = d.withColumn("sample_id", spec.sample_id(F.col("seq"), F.col("lat_patch"), F.col("lon_patch"))).withColumn("seq_start", F.col("seq") * spec.stride)
    return d.select("sample_id", "seq", "seq_start", "lat_patch", "lon_patch")


def sample_subset(index: DataFrame, n: int, split: float, seed: int = 33) -> tuple[DataFrame, DataFrame]:
    """(training, validation) samples drawn without replacement in a hashed order: ``int(n * split)`` and the rest."""
    shuffled = index.withColumn("__h", F.xxhash64("sample_id", F.lit(seed)))
    n_train = int(n * split)
    order = [F.col("__h"), F.col("sample_id")]
    return shuffled.orderBy(*order).limit(n_train).drop("__h"), shuffled.orderBy(*order).offset(n_train).limit(n - n_train).drop("__h")


def batches(index: DataFrame, size: int, seed: int | None = None, buckets: int = 1024) -> DataFrame:
    """Adds ``batch``: samples in batches of exactly ``size`` (the last one may be smaller), in the order of their numbers
    or, with ``seed``, in a hashed one.

    Samples are ordered only within ``buckets`` ranges of that order; running totals of the ranges' counts give the rest.
    """
    n = max(int(index.agg(F.max("sample_id")).first()[0] or 0), 0) + 1
    key = F.col("sample_id") if seed is None else F.xxhash64("sample_id", F.lit(seed))
    part = F.floor(F.col("sample_id") * buckets / n).cast("int") if seed is None else F.shiftrightunsigned(key, 64 - (buckets.bit_length() - 1)).cast("int")
    d = index.withColumns({"__key": key, "__part": part})
    sizes = d.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("__key", "sample_id")) - 1
    return d.join(F.broadcast(before), "__part").withColumn("batch", F.floor(rank / size).cast("long")).drop("__key", "__part", "__before")


def planes(df: DataFrame, keys: Sequence[str], cell: Column, columns: Sequence[Column], size: int) -> DataFrame:
    """``keys, planes``: per group one array of floats, column after column, each of ``size`` cells; missing ones are 0.

    Cells are shuffled once, narrow; whole groups of sorted batches are placed by numpy.
    """
    keys, names = list(keys), [f"__v{i}" for i in range(len(columns))]
    d = df.select(*keys, cell.cast("int").alias("__c"), *[c.cast("float").alias(n) for c, n in zip(columns, names)])
    d = d.repartition(*keys).sortWithinPartitions(*keys)
    at_once = max(1, 16_000_000 // max(1, len(names) * size))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, start in whole_groups(batches, keys, at_once):
            g = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pdf))))
            out = np.zeros((len(start), len(names), size), np.float32)
            out[g, :, pdf["__c"].to_numpy()] = np.nan_to_num(pdf[names].to_numpy(np.float32))
            yield pd.DataFrame({k: pdf[k].to_numpy()[start] for k in keys} | {"planes": list(out.reshape(len(start), -1))})

    return d.mapInPandas(build, ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", planes array<float>")


def materialise(df: DataFrame, spec: WindowSpec, features: Sequence[str], target: str, mask: str | None, index: DataFrame | None = None, time: str = "time", it: str = "it",
                land_cover: DataFrame | None = None, land_cover_features: Sequence[str] = ()) -> DataFrame:
    """One row per sample with row-major arrays: ``x`` (L_in, C, H, W), ``y`` and ``flag_y`` (L_out, H, W), ``doy_x`` and
    ``doy_y`` (steps, sine and cosine). Cells and steps missing from the cube are 0; without a mask variable ``flag_y``
    is 0. ``index`` names the samples wanted, else all that have a cell.

    ``land_cover`` (``year_start, iy, ix`` and the columns of ``land_cover_features``) adds channels after the features: the
    slice valid at the start of the year of the window's first step, the same at every step.

    Each plane of a patch is made once, from narrow cells; windows that share a step share its plane, which is the only
    thing that is sent to them.
    """
    from gridspark.functions.scalar import doy_encoding
    from gridspark.operators.align import asof_year

    h, w = spec.patch or spec.ny, spec.patch or spec.nx
    size, n = h * w, len(features)
    cell = (F.col("iy") % h) * w + F.col("ix") % w if spec.patch else F.col("iy") * w + F.col("ix")
    flag = F.col(mask) if mask and mask in df.columns else F.lit(0)
    inside = add_patch(df.filter(F.col("iy").between(0, spec.ny - 1) & F.col("ix").between(0, spec.nx - 1)), spec)
    steps = planes(inside, ["lat_patch", "lon_patch", it], cell, [*[F.col(f) for f in features], F.col(target), flag], size)
    d = sequence_windows(steps, spec, it)
    x, y, m = (F.slice("planes", 1 + a * size, b * size) for a, b in ((0, n), (n, 1), (n + 1, 1)))
    of = lambda role, c: F.when(F.col("role") == role, c)
    none = F.lit(None).cast("array<float>")
    d = d.select("seq", "lat_patch", "lon_patch", "step", of("x", x).alias("x"), of("y", y).alias("y"), of("y", m).alias("m"))
    dates = sequence_windows(df.select(time, it).distinct(), spec, it)
    if land_cover is not None:
        first = dates.filter("step = 0").select("seq", F.to_date(F.col(time)).alias("date"))
        lc = planes(add_patch(land_cover.filter(F.col("iy").between(0, spec.ny - 1) & F.col("ix").between(0, spec.nx - 1)), spec), ["lat_patch", "lon_patch", "year_start"], cell, [F.col(c) for c in land_cover_features], size)
        years = asof_year(first, land_cover.select("year_start").distinct()).select("seq", F.col("lc_year").alias("year_start"))
        lc = lc.withColumn("year_start", F.to_date("year_start")).join(F.broadcast(years), "year_start")
        d = d.unionByName(lc.select("seq", "lat_patch", "lon_patch", F.lit(-1).alias("step"), F.col("planes").alias("x"), none.alias("y"), none.alias("m")))
    d = d.withColumn("sample_id", spec.sample_id(F.col("seq"), F.col("lat_patch"), F.col("lon_patch")))
    if index is not None:
        wanted = index.select("seq", "lat_patch", "lon_patch", F.lit(-2).alias("step"), none.alias("x"), none.alias("y"), none.alias("m"), "sample_id")
        d = d.join(index.select("sample_id"), "sample_id", "left_semi").unionByName(wanted)
    g = d.groupBy("sample_id", "seq", "lat_patch", "lon_patch").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("step") >= 0, F.struct("step", F.coalesce("x", "y").alias("p"))))).alias("p"),
        F.map_from_entries(F.collect_list(F.when(F.col("step") >= spec.l_in, F.struct("step", "m")))).alias("m"),
        F.first(F.when(F.col("step") == -1, F.col("x")), True).alias("lc"), F.max("step").alias("last"))
    if index is None:
        g = g.filter("last >= 0")
    zeros = lambda k: F.array_repeat(F.lit(0.0).cast("float"), k)
    x_steps, y_steps = F.sequence(F.lit(0), F.lit(spec.l_in - 1)), F.sequence(F.lit(spec.l_in), F.lit(spec.length - 1))
    one = lambda k, c, width: F.coalesce(F.try_element_at(c, k), zeros(width))
    extra = F.coalesce("lc", zeros(len(land_cover_features) * size)) if land_cover is not None else None
    sin, cos = doy_encoding(F.col(time))
    days = dates.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", sin.alias("s"), cos.alias("c")))), lambda s: F.array(s["s"], s["c"])).alias("doy"))
    g = g.join(F.broadcast(days), "seq")
    return g.select(
        "sample_id", "seq", "lat_patch", "lon_patch",
        F.flatten(F.transform(x_steps, lambda k: one(k, F.col("p"), n * size) if extra is None else F.concat(one(k, F.col("p"), n * size), extra))).alias("x"),
        F.flatten(F.transform(y_steps, lambda k: one(k, F.col("p"), size))).alias("y"),
        F.flatten(F.transform(y_steps, lambda k: one(k, F.col("m"), size))).cast("array<int>").alias("flag_y"),
        F.flatten(F.slice("doy", 1, spec.l_in)).alias("doy_x"), F.flatten(F.slice("doy", spec.l_in + 1, spec.l_out)).alias("doy_y"), (F.col("seq") * spec.stride).alias("seq_start"))


def sample_cells(df: DataFrame, spec: WindowSpec, sample: int, it: str = "it") -> tuple[DataFrame, DataFrame]:
    """The rows (input steps, target steps) of one sample, for looking at; none where there is no such sample."""
    ny, nx = spec.patches
    if not 0 <= sample < spec.n_samples:
        return df.limit(0), df.limit(0)
    seq, rest = divmod(sample, ny * nx)
    lon_p, lat_p = divmod(rest, ny)
    if spec.patch is not None:
        df = slice_index(df, iy=(lat_p * spec.patch, (lat_p + 1) * spec.patch), ix=(lon_p * spec.patch, (lon_p + 1) * spec.patch))
    a = seq * spec.stride
    return slice_index(df, **{it: (a, a + spec.l_in)}), slice_index(df, **{it: (a + spec.l_in, a + spec.length)})
