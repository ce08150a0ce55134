"""Training of the ConvLSTM networks, data-parallel on Spark: gradients in numpy where the samples lie, summed by an aggregate.

Each step sends the weights to the tasks, runs the network and its derivative over the samples of one batch, and adds up
one gradient per task; what reaches the driver is as large as the network. Optimiser, schedule, early stopping and
checkpoints are the driver's. There is no half-precision scaling, as everything is computed in 64 bits.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.config import latest_checkpoint
from gridspark.operators.forecast import conv2d, stacked

Weights = dict[str, np.ndarray]


# --- derivative -----------------------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    r = k // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (r, r), (r, r))), (k, k), axis=(1, 2))[:, : x.shape[1], : x.shape[2]]


class _Run:
    """One sample through the network, with what its derivative needs."""

    def __init__(self, w: Weights, size: tuple[int, int], dropout: float = 0.0, rng: np.random.Generator | None = None):
        self.w, self.layers = w, ("_1", "_2") if stacked(w) else ("",)
        self.hidden = w[f"encoder{self.layers[0]}.conv.bias"].shape[0] // 4
        zero = np.zeros((self.hidden, *size))
        self.state, self.slope = [(zero, zero) for _ in self.layers], [(zero, zero) for _ in self.layers]
        self.dropout, self.rng = dropout, rng
        self.grad = {n: np.zeros_like(a, dtype=float) for n, a in w.items()}

    def step(self, side: str, v: np.ndarray) -> tuple[np.ndarray, list]:
        memo = []
        for n, layer in enumerate(self.layers):
            keep = 1.0
            if n and self.dropout and self.rng is not None:  # whole channels, as between layers in training
                keep = (self.rng.random(len(v)) >= self.dropout)[:, None, None] / (1 - self.dropout)
                v = v * keep
            h, c = self.state[n]
            x = np.concatenate([v, h])
            z = conv2d(x, self.w[f"{side}{layer}.conv.weight"], self.w[f"{side}{layer}.conv.bias"])
            i, f, o = (_sigmoid(a) for a in np.split(z, 4)[:3])
            g = np.tanh(np.split(z, 4)[3])
            new = f * c + i * g
            t = np.tanh(new)
            memo.append((f"{side}{layer}", x, len(v), i, f, o, g, c, t, keep))
            self.state[n] = (o * t, new)
            v = o * t
        return v, memo

    def back(self, memo: list, dv: np.ndarray) -> np.ndarray:
        """Slope at the step's input, from that at its output; adds to the weights' slopes."""
        for n in range(len(memo) - 1, -1, -1):
            name, x, own, i, f, o, g, c, t, keep = memo[n]
            dh, dc = self.slope[n][0] + dv, self.slope[n][1]
            dc = dc + dh * o * (1 - t * t)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)])
            weight = self.w[f"{name}.conv.weight"]
            self.grad[f"{name}.conv.weight"] += np.tensordot(dz, _windows(x, weight.shape[-1]), axes=([1, 2], [1, 2]))
            self.grad[f"{name}.conv.bias"] += dz.sum((1, 2))
            dx = conv2d(dz, weight.transpose(1, 0, 2, 3)[:, :, ::-1, ::-1], np.zeros(weight.shape[1]))
            self.slope[n] = (dx[own:], dc * f)
            dv = dx[:own] * (keep if n else 1.0)
        return dv


def errors_and_gradient(w: Weights, x: np.ndarray, y: np.ndarray, flag: np.ndarray, doy_x: np.ndarray | None, doy_y: np.ndarray | None, dropout: float = 0.0,
                        rng: np.random.Generator | None = None, slope: bool = True) -> tuple[np.ndarray, Weights]:
    """(masked errors (l_out, H, W) with NaN where the flag isn't 1, gradient of half their sum of squares) of one sample."""
    run, size = _Run(w, x.shape[2:], dropout, rng), x.shape[2:]
    plane = lambda d: np.broadcast_to(np.asarray(d)[:, None, None], (2, *size))
    memos = [run.step("encoder", x[t] if doy_x is None else np.concatenate([x[t], plane(doy_x[t])]))[1] for t in range(len(x))]
    fc, prev, tops, outs, after = w["fc.weight"][:, :, 0, 0], np.zeros((len(w["fc.bias"]), *size)), [], [], []
    for t in range(len(y)):
        top, memo = run.step("decoder", prev)
        top = top if doy_y is None else np.concatenate([top, plane(doy_y[t])])
        prev = np.tensordot(fc, top, axes=(1, 0)) + w["fc.bias"][:, None, None]
        after.append(memo), tops.append(top), outs.append(prev)
    error = np.where(flag == 1, np.stack(outs)[:, 0] - y, np.nan)
    if not slope:
        return error, {}
    feed = np.zeros_like(prev)
    for t in range(len(y) - 1, -1, -1):
        d = feed + np.nan_to_num(error[t])[None] * (np.arange(len(prev)) == 0)[:, None, None]
        run.grad["fc.weight"][:, :, 0, 0] += np.tensordot(d, tops[t], axes=([1, 2], [1, 2]))
        run.grad["fc.bias"] += d.sum((1, 2))
        feed = run.back(after[t], np.tensordot(fc.T, d, axes=(1, 0))[: run.hidden])
    for memo in reversed(memos):
        run.back(memo, np.zeros((run.hidden, *size)))
    return error, run.grad


# --- on Spark -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Shape:
    """Sizes of the samples' tensors: steps in and out, channels, height, width."""

    l_in: int
    l_out: int
    channels: int
    height: int
    width: int

    def tensors(self, r) -> tuple[np.ndarray, ...]:
        plane = (self.height, self.width)
        return (np.asarray(r.x, float).reshape(self.l_in, self.channels, *plane), np.asarray(r.y, float).reshape(self.l_out, *plane), np.asarray(r.flag_y).reshape(self.l_out, *plane),
                np.asarray(r.doy_x, float).reshape(self.l_in, 2), np.asarray(r.doy_y, float).reshape(self.l_out, 2))


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([np.ravel(w[n]) for n in sorted(w)])


def unflat(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = np.asarray(v[at: at + like[n].size], float).reshape(like[n].shape)
        at += like[n].size
    return out


def batch_gradient(samples: DataFrame, w: Weights, shape: Shape, dropout: float = 0.0, seed: int = 0) -> tuple[float, np.ndarray]:
    """(mean squared error over valid cells, its gradient) of the samples."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square, n = 0.0, 0.0, 0
        for pdf in batches:
            for r in pdf.itertuples():
                rng = np.random.default_rng([seed, int(r.sample_id)])
                e, g = errors_and_gradient(w, *shape.tensors(r), dropout, rng)
                total, square, n = total + flat(g), square + float(np.nansum(e * e)), n + int((~np.isnan(e)).sum())
        if n:
            yield pd.DataFrame({"square": [square], "n": [n], "g": [total]})

    parts = samples.select("sample_id", "x", "y", "flag_y", "doy_x", "doy_y").mapInPandas(run, "square double, n long, g array<double>")
    # summed by place, so no task holds more than one gradient and the driver gets one
    g = parts.select(F.posexplode(F.concat(F.array(F.col("square"), F.col("n").cast("double")), "g")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    got = {r["i"]: r["v"] for r in g.collect()}
    if not got:
        return 0.0, np.zeros(flat(w).size)
    n = max(got[1], 1.0)
    return got[0] / n, 2 * np.array([got[k] for k in range(2, len(got))]) / n


def validation(samples: DataFrame, w: Weights, shape: Shape) -> pd.DataFrame:
    """``batch, lead, square, n``: sums of squared errors on valid cells."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                e, _ = errors_and_gradient(w, *shape.tensors(r), slope=False)
                rows += [(r.batch, k + 1, float(np.nansum(e[k] ** 2)), int((~np.isnan(e[k])).sum())) for k in range(len(e))]
            yield pd.DataFrame(rows, columns=["batch", "lead", "square", "n"])

    d = samples.select("batch", "x", "y", "flag_y", "doy_x", "doy_y").mapInPandas(run, "batch long, lead int, square double, n long")
    return d.groupBy("batch", "lead").agg(F.sum("square").alias("square"), F.sum("n").alias("n")).toPandas()


# --- the loop -------------------------------------------------------------------------------------------------

@dataclass
class State:
    """All that a run needs to go on: weights, Adam's moments, schedule and counters."""

    w: Weights
    lr: float
    epoch: int = 0
    steps: int = 0
    best: float = float("inf")
    idle: int = 0
    plateau_best: float = float("inf")
    plateau_idle: int = 0
    m: np.ndarray = field(default=None)
    v: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        size = flat(self.w).size
        self.m, self.v = (np.zeros(size) if a is None else a for a in (self.m, self.v))

    def save(self, path: str) -> None:
        plain = {k: getattr(self, k) for k in ("lr", "epoch", "steps", "best", "idle", "plateau_best", "plateau_idle", "m", "v")}
        np.savez(path, **plain, **{f"w:{n}": a for n, a in self.w.items()})

    @classmethod
    def load(cls, path: str) -> State:
        with np.load(path) as z:
            w = {n[2:]: z[n] for n in z.files if n.startswith("w:")}
            return cls(w, **{n: z[n] if z[n].ndim else z[n].item() for n in z.files if not n.startswith("w:")})

    def adam(self, g: np.ndarray, clip: float = 1.0, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
        """One step along the gradient, whose norm is cut to ``clip``."""
        g = g * min(1.0, clip / (float(np.linalg.norm(g)) + 1e-6))
        self.steps += 1
        self.m, self.v = b1 * self.m + (1 - b1) * g, b2 * self.v + (1 - b2) * g * g
        step = (self.m / (1 - b1 ** self.steps)) / (np.sqrt(self.v / (1 - b2 ** self.steps)) + eps)
        self.w = unflat(flat(self.w) - self.lr * step, self.w)

    def plateau(self, loss: float, patience: int, factor: float = 0.5, least: float = 1e-6, relative: float = 1e-4) -> None:
        """Half the rate after more than ``patience`` epochs without a relative gain."""
        if loss < self.plateau_best * (1 - relative):
            self.plateau_best, self.plateau_idle = loss, 0
        else:
            self.plateau_idle += 1
        if self.plateau_idle > patience:
            self.lr, self.plateau_idle = max(self.lr * factor, least), 0


def fit(train: DataFrame, val: DataFrame, shape: Shape, w: Weights, epochs: int, lr: float = 1e-3, folder: str | None = None, checkpoint_epochs: int = 5, resume: str | None = None, accumulation: int = 1,
        patience: int | None = None, min_delta: float = 0.0, scheduler_patience: int = 7, dropout: float = 0.0) -> tuple[Weights, list[dict]]:
    """(best weights, history) of training on ``train`` and ``val`` (samples with ``batch``).

    ``resume`` names a folder; its checkpoint with the greatest name is taken up where there is one. The best weights
    and a checkpoint every ``checkpoint_epochs`` epochs are kept in ``folder``. ``accumulation`` batches make one step.
    """
    state = State(w, lr)
    last = latest_checkpoint([os.path.join(resume, f) for f in os.listdir(resume)]) if resume and os.path.isdir(resume) else None
    if last:
        state = State.load(last)
        state.epoch += 1
    best, history = state.w, []
    kept = os.path.join(folder, "best_model.npz") if folder else None
    batches = sorted(r[0] for r in train.select("batch").distinct().collect())  # one number a batch
    for epoch in range(state.epoch, epochs):
        state.epoch, losses, total, held = epoch, [], 0.0, 0
        for k, b in enumerate(batches):
            loss, g = batch_gradient(train.filter(F.col("batch") == b), state.w, shape, dropout, seed=epoch)
            losses.append(loss)
            total, held = total + g / accumulation, held + 1
            if held == accumulation or k + 1 == len(batches):
                state.adam(total)
                total, held = 0.0, 0
        e = validation(val, state.w, shape)
        per_batch = e.groupby("batch")[["square", "n"]].sum()
        val_losses = (per_batch["square"] / per_batch["n"].clip(lower=1)).to_numpy()
        by_lead = e.groupby("lead")[["square", "n"]].sum()
        state.plateau(float(val_losses.mean()) if len(val_losses) else 0.0, scheduler_patience)
        if val_losses.sum() < state.best - min_delta:
            state.best, state.idle, best = float(val_losses.sum()), 0, state.w
            if kept:
                State(best, state.lr).save(kept)
        else:
            state.idle += 1
        history.append({"epoch": epoch, "lr": state.lr, "train_loss": float(np.mean(losses)) if losses else 0.0, "val_loss": float(val_losses.mean()) if len(val_losses) else 0.0,
                        "rmse_by_lead": np.sqrt(by_lead["square"] / by_lead["n"].clip(lower=1)).tolist(), "best": state.idle == 0})
        if patience is not None and state.idle >= patience:
            break
        if folder and epoch % checkpoint_epochs == 0:
            state.save(os.path.join(folder, f"checkpoint_{epoch:04d}.npz"))
    if kept and os.path.exists(kept):
        best = State.load(kept).w
    return best, history


def metrics_table(spark: SparkSession, history: list[dict]) -> DataFrame:
    """``epoch, metric, lead, value``: learning rate, losses and validation error by lead of a run."""
    rows = [(h["epoch"], m, None, h[m]) for h in history for m in ("lr", "train_loss", "val_loss")]
    rows += [(h["epoch"], "rmse", k + 1, v) for h in history for k, v in enumerate(h["rmse_by_lead"])]
    return spark.createDataFrame(rows, "epoch int, metric string, lead int, value double")


def options(args: list[str] | None = None) -> argparse.Namespace:
    """Command-line options of a training run."""
    p = argparse.ArgumentParser(description="Train a forecast network.")
    p.add_argument("--config", required=True, help="run configuration, YAML or JSON")
    p.add_argument("--profile", action="store_true", help="log Spark's plans and times")
    p.add_argument("--checkpoint-epochs", type=int, default=5, help="a checkpoint every N epochs")
    p.add_argument("--resume", action=argparse.BooleanOptionalAction, default=False, help="go on from the latest checkpoint")
    p.add_argument("--resume-checkpoint-dir", help="folder of the checkpoints to go on from")
    p.add_argument("--accumulation-steps", type=int, default=1, help="batches whose gradients make one step")
    return p.parse_args(args)
