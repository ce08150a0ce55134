"""Forecast cubes and ConvLSTM inference.

The network runs in numpy inside ``applyInPandas``, one spatial tile of a few sequences at a time, which share the steps
they have in common. A 3 x 3 convolution spreads one cell a step, so a tile with a halo of ``(steps) * (kernel // 2)``
cells around it gives exactly what the whole area would; zero padding happens only at the true edges of the domain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.scalar import to_half
from gridspark.operators.windows import WindowSpec

CLAMP = 1e6


# --- network --------------------------------------------------------------------------------------------------

def conv2d(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Same-size convolution of (C, H, W) with (O, C, k, k), zero padding."""
    o, c, k, _ = weight.shape
    r = k // 2
    padded = np.pad(x, ((0, 0), (r, r), (r, r)))
    win = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(1, 2))[:, : x.shape[1], : x.shape[2]]
    return np.tensordot(weight, win, axes=([1, 2, 3], [0, 3, 4])) + bias[:, None, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def lstm_step(w: dict[str, np.ndarray], name: str, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New (hidden, cell) state; gates in the order input, forget, output, candidate."""
    z = conv2d(np.concatenate([x, h]), w[f"{name}.conv.weight"], w[f"{name}.conv.bias"])
    i, f, o, g = np.split(z, 4)
    c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
    h = _sigmoid(o) * np.tanh(c)
    return np.clip(h, -CLAMP, CLAMP), np.clip(c, -CLAMP, CLAMP)


def stacked(weights: dict) -> bool:
    return any(k.startswith("encoder_1") for k in weights)


def run_network(w: dict[str, np.ndarray], x: np.ndarray, doy_x: np.ndarray | None, doy_y: np.ndarray | None, l_out: int) -> np.ndarray:
    """(l_out, target, H, W) from x (l_in, C, H, W): encoder over the inputs, then an autoregressive decoder from zeros.

    With day-of-year features (steps, 2) they join the encoder's input and the last layer's input; without, plain.
    """
    layers = ("_1", "_2") if stacked(w) else ("",)
    size = x.shape[2:]
    hidden = w[f"encoder{layers[0]}.conv.bias"].shape[0] // 4
    state = [(np.zeros((hidden, *size)), np.zeros((hidden, *size))) for _ in layers]
    plane = lambda d: np.broadcast_to(np.asarray(d)[:, None, None], (2, *size))

    def step(side: str, v: np.ndarray) -> np.ndarray:
        for n, layer in enumerate(layers):
            state[n] = lstm_step(w, side + layer, v, *state[n])
            v = state[n][0]
        return v

    for t in range(len(x)):
        step("encoder", x[t] if doy_x is None else np.concatenate([x[t], plane(doy_x[t])]))
    fc, bias = w["fc.weight"][:, :, 0, 0], w["fc.bias"]
    prev, out = np.zeros((len(bias), *size)), []
    for t in range(l_out):
        top = step("decoder", prev)
        top = top if doy_y is None else np.concatenate([top, plane(doy_y[t])])
        prev = np.tensordot(fc, top, axes=(1, 0)) + bias[:, None, None]
        out.append(prev)
    return np.stack(out)


def halo_cells(l_in: int, l_out: int, kernel: int, two_layers: bool) -> int:
    steps = (2 * l_in + 2 * l_out) if two_layers else l_in + l_out
    return steps * (kernel // 2)


def load_weights(table: DataFrame) -> dict[str, np.ndarray]:
    """Weights from rows ``name, shape, data``: a model, some tens of thousands of numbers."""
    return {r["name"]: np.asarray(r["data"], float).reshape(r["shape"]) for r in table.collect()}


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    rows = [(n, [int(s) for s in a.shape], [float(v) for v in np.ravel(a)]) for n, a in weights.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, data array<double>")


def random_weights(n_in: int, hidden: int, kernel: int = 3, target: int = 1, two_layers: bool = False, doy: bool = True, seed: int = 0) -> dict[str, np.ndarray]:
    """A network of the right shape, for tests and as a starting point."""
    rng, extra = np.random.default_rng(seed), 2 if doy else 0
    w: dict[str, np.ndarray] = {}

    def cell(name: str, c: int) -> None:
        w[f"{name}.conv.weight"] = rng.normal(0, 0.2, (4 * hidden, c + hidden, kernel, kernel))
        w[f"{name}.conv.bias"] = rng.normal(0, 0.1, 4 * hidden)

    first = "_1" if two_layers else ""
    cell(f"encoder{first}", n_in + extra)
    cell(f"decoder{first}", target)
    if two_layers:
        cell("encoder_2", hidden)
        cell("decoder_2", hidden)
    w["fc.weight"], w["fc.bias"] = rng.normal(0, 0.2, (target, hidden + extra, 1, 1)), rng.normal(0, 0.1, target)
    return w


def predict(cube: DataFrame, spec: WindowSpec, features: Sequence[str], weights: dict[str, np.ndarray], tile: int = 128, doy: bool = True, time: str = "time", it: str = "it", block: int = 8) -> DataFrame:
    """``seq, lead, iy, ix, pred`` for every sequence (stride and patches of ``spec`` don't apply: whole area, stride 1).

    Cells missing from the cube count as 0, as at the edge of the domain. ``block`` sequences are predicted by one task
    from ``block + l_in - 1`` steps, so a step is sent to about ``1 + l_in / block`` tasks, not to every window it is in.
    """
    s = WindowSpec(spec.steps, spec.ny, spec.nx, spec.l_in, spec.l_out)
    kernel = next(a for n, a in weights.items() if n.endswith("conv.weight")).shape[-1]
    halo, n = halo_cells(s.l_in, s.l_out, kernel, stacked(weights)), len(features)
    schema = "seq int, lead int, iy int, ix int, pred double"
    if s.n_sequences == 0:
        return cube.sparkSession.createDataFrame([], schema)
    from gridspark.functions.scalar import doy_encoding

    # the calendar: two numbers a step
    days = np.zeros((s.steps, 2))
    for r in cube.select(F.col(it).alias("i"), *[c.alias(k) for c, k in zip(doy_encoding(F.col(time)), "sc")]).distinct().filter(F.col("i").between(0, s.steps - 1)).collect():
        days[r["i"]] = r["s"], r["c"]
    i = F.col(it)
    first, last = F.greatest(i - (s.l_in - 1), F.lit(0)), F.least(i, F.lit(s.n_sequences - 1))
    at = lambda c, v, size: F.floor((F.col(c) + v) / size).cast("int")
    span = lambda c, n_cells: F.explode(F.sequence(F.greatest(at(c, -halo, tile), F.lit(0)), F.least(at(c, halo, tile), F.lit((n_cells - 1) // tile))))
    d = cube.filter(first <= last).withColumn("b", F.explode(F.sequence(F.floor(first / block).cast("int"), F.floor(last / block).cast("int"))))
    d = d.withColumn("ty", span("iy", s.ny)).withColumn("tx", span("ix", s.nx))
    d = d.select("b", "ty", "tx", i.cast("int").alias("step"), "iy", "ix", *[F.col(f).cast("float").alias(f"f{k}") for k, f in enumerate(features)])
    names = [f"f{k}" for k in range(n)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b, ty, tx = (int(k) for k in key)
        y0, y1 = max(ty * tile - halo, 0), min((ty + 1) * tile + halo, s.ny)
        x0, x1 = max(tx * tile - halo, 0), min((tx + 1) * tile + halo, s.nx)
        x = np.zeros((block + s.l_in - 1, n, y1 - y0, x1 - x0))
        step = pdf["step"].to_numpy(int) - b * block
        x[step, :, pdf["iy"].to_numpy(int) - y0, pdf["ix"].to_numpy(int) - x0] = np.nan_to_num(pdf[names].to_numpy(float))
        a, c, parts = ty * tile - y0, tx * tile - x0, []
        for k in range(min(block, s.n_sequences - b * block)):
            seq = b * block + k
            out = run_network(weights, x[k: k + s.l_in], days[seq: seq + s.l_in] if doy else None, days[seq + s.l_in: seq + s.length] if doy else None, s.l_out)[:, 0]
            out = out[:, a: a + tile, c: c + tile][:, : s.ny - ty * tile, : s.nx - tx * tile]
            lead, yy, xx = (v.ravel() for v in np.indices(out.shape))
            parts.append(pd.DataFrame({"seq": seq, "lead": lead + 1, "iy": yy + ty * tile, "ix": xx + tx * tile, "pred": out.ravel()}))
        return pd.concat(parts)

    return d.groupBy("b", "ty", "tx").applyInPandas(run, schema)


# --- forecast cube ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Leads:
    """A range of lead times, 1 <= first <= last <= l_out."""

    first: int
    last: int

    def check(self, l_out: int) -> None:
        if not 1 <= self.first <= self.last <= l_out:
            raise ValueError(f"lead times {self.first} to {self.last} are not within 1 to {l_out}")


def init_times(cube: DataFrame, l_in: int, time: str = "time", it: str = "it") -> DataFrame:
    """``init, it, iy, ix, LAI_norm`` of the steps a forecast can start from."""
    return cube.filter(F.col(it) >= l_in - 1).select(F.col(time).alias("init_date"), F.col(it).alias("it"), "iy", "ix", F.col("LAI_norm").cast("double").alias("LAI_norm"))


def forecast_cube(cube: DataFrame, predictions: DataFrame, l_in: int, l_out: int, tail: str = "zero", half: bool = False, leads: Leads | None = None, time: str = "time", it: str = "it") -> DataFrame:
    """``init_date, lead, iy, ix, LAI_norm``: lead 0 is the observation, leads 1..l_out the predictions
    (``seq, lead, iy, ix, pred``).

    The last init times have no prediction; ``tail`` makes them ``zero``, ``null`` or ``drop``s them. With ``leads``
    only that range comes out, without lead 0.
    """
    if tail not in ("zero", "null", "drop"):
        raise ValueError(f"unknown tail {tail}")
    if leads:
        leads.check(l_out)
        predictions = predictions.filter(F.col("lead").between(leads.first, leads.last))
    start = init_times(cube, l_in, time, it)
    first, last = (leads.first, leads.last) if leads else (1, l_out)
    slots = start.select("init_date", (F.col("it") - (l_in - 1)).alias("seq"), "iy", "ix", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lead"))
    p = predictions.select("seq", "lead", "iy", "ix", F.col("pred").cast("double").alias("LAI_norm"))
    d = slots.join(p, ["seq", "lead", "iy", "ix"], "inner" if tail == "drop" else "left").select("init_date", "lead", "iy", "ix", "LAI_norm")
    if tail == "zero":
        d = d.withColumn("LAI_norm", F.coalesce("LAI_norm", F.lit(0.0)))
    if not leads:
        d = start.select("init_date", F.lit(0).alias("lead"), "iy", "ix", "LAI_norm").unionByName(d)
    return d.withColumn("LAI_norm", to_half(F.col("LAI_norm"))) if half else d


def valid_date(d: DataFrame, init: str = "init_date", lead: str = "lead") -> DataFrame:
    """Adds the day a forecast is for."""
    return d.withColumn("valid_date", F.date_add(F.to_date(F.col(init)), F.col(lead)))


def append_period(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """(both periods, number of init times before the new one); init times already there are not added again."""
    offset = existing.select("init_date").distinct().count()
    fresh = new.join(existing.select("init_date").distinct(), "init_date", "left_anti")
    return existing.unionByName(fresh), offset


def persistence(cube: DataFrame, l_in: int, l_out: int, it: str = "it") -> DataFrame:
    """Predictions that repeat the last observed value, for every sequence with a full target."""
    last = cube.agg(F.max(it)).first()[0]
    if last is None:
        last = -1
    s = cube.filter((F.col(it) >= l_in - 1) & (F.col(it) + l_out <= last))
    return s.select((F.col(it) - (l_in - 1)).alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(l_out))).alias("lead"), "iy", "ix", F.col("LAI_norm").cast("double").alias("pred"))


def score(forecast: DataFrame, cube: DataFrame, flag: str = "LAI_flag", time: str = "time") -> DataFrame:
    """Predictions beside what was observed on their day: ``init_date, lead, iy, ix, pred, true, flag``."""
    f = valid_date(forecast.filter("lead > 0")).withColumnRenamed("LAI_norm", "pred")
    obs = cube.select(F.to_date(F.col(time)).alias("valid_date"), "iy", "ix", F.col("LAI_norm").cast("double").alias("true"), F.col(flag).cast("int").alias("flag"))
    return f.join(obs, ["valid_date", "iy", "ix"]).select("init_date", "lead", "iy", "ix", "pred", "true", "flag")


@dataclass(frozen=True)
class Inference:
    """What a forecast run needs beside the cube and the network."""

    l_in: int
    l_out: int
    features: tuple[str, ...] = ("LAI_norm", "LAI_flag")
    first_lead: int | None = None
    last_lead: int | None = None
    tail: str = "zero"
    half: bool = True

    def leads(self) -> Leads | None:
        if (self.first_lead is None) != (self.last_lead is None):
            raise ValueError("the first and the last lead time go together")
        if self.first_lead is None:
            return None
        leads = Leads(self.first_lead, self.last_lead)
        leads.check(self.l_out)
        return leads


def run_forecast(cube: DataFrame, weights: dict[str, np.ndarray], run: Inference, flags: DataFrame | None = None, flag: str = "LAI_flag", output: str | None = None, append: bool = False, time: str = "time") -> tuple[DataFrame, int]:
    """(forecast cube, number of init times stored before it): from a cube of ``time, iy, ix`` and the features.

    ``flags`` (``time, iy, ix`` and ``flag``, over the same labels) replaces the cube's flag. With ``output`` the cube is
    written there, init time by init time; ``append`` adds those not stored yet to what is there, else it must be new.
    """
    from gridspark.operators.align import replace_variable
    from gridspark.operators.windows import time_index
    from gridspark.sources.cube import exists

    leads = run.leads()
    if flags is not None:
        cube = replace_variable(cube, flags, flag)
    c = time_index(cube, time)
    r = c.agg(F.max("it"), F.max("iy"), F.max("ix")).first()
    if r[0] is None:
        raise ValueError("the cube is empty")
    spec = WindowSpec(r[0] + 1, r[1] + 1, r[2] + 1, run.l_in, run.l_out)
    f = forecast_cube(c, predict(c, spec, run.features, weights, time=time), run.l_in, run.l_out, run.tail, run.half, leads, time)
    if output is None:
        return f, 0
    spark, offset = cube.sparkSession, 0
    if append and exists(spark, output):
        offset = spark.read.parquet(output).select("init_date").distinct().count()
        f = f.join(spark.read.parquet(output).select("init_date").distinct(), "init_date", "left_anti")
    f.withColumn("year", F.year("init_date")).write.mode("append" if append else "errorifexists").option("compression", "zstd").partitionBy("year").parquet(output)
    return spark.read.parquet(output).drop("year"), offset
