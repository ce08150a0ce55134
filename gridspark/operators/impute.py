"""Missing values filled from similar records: nearby cells of the same day and nearby days of the same cell.

Numeric fields follow a mixed-effects model ``y = mu + day effect + cell effect + e``. The day effect is taken from
the cells within ``SPACE`` of the same day, the cell effect from the same cell within ``TIME`` days, each shrunk
towards zero by ``residual variance / effect variance``; the variances come from all rows. Categorical fields
follow a multinomial logistic model: the score of a class is an intercept plus weights times the class's log share among
the day's neighbours and among the cell's days, both shares shrunk towards the overall ones. Intercepts and weights are
fitted by Newton's method to observed values, each seen as if it were missing, of at most ``FIT_TILES`` tiles chosen by
hash. Every filled value is marked.

Cells and days are packed into dense numpy tiles with a halo, and neighbourhood sums are box filters, so the cost
follows the rows, not the number of gaps. A tile's size is fixed, so no group grows with the data; rows that
repeat (cell, day) are merged by a partial aggregate first (valid values win).

Defined results: a value is missing if NULL, NaN, infinite or outside its field's range or classes; a missing value
with no valid neighbour stays NULL and unmarked; rows with a NULL cell or day come out unfilled; an empty table
gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import in_range

SPACE, TIME = 2, 3
TILE, TILE_DAYS = 24, 30
PRIOR = 1.0
#: tiles whose observed values fit the multinomial model
FIT_TILES = 16


@dataclass(frozen=True)
class Numeric:
    name: str
    low: float
    high: float


@dataclass(frozen=True)
class Category:
    name: str
    classes: tuple[int, ...]


FIELDS = (Numeric("prcp", 0.0, 2000.0), Numeric("tmax", -90.0, 60.0), Category("temp_flag", (0, 1)), Category("prcp_flag", (0, 1)))


def valid_value(f: Numeric | Category) -> Column:
    """The field as double where valid, else NULL."""
    c = F.col(f.name)
    if isinstance(f, Numeric):
        return in_range(c, f.low, f.high)
    return F.when(c.isin(*f.classes), c.cast("double"))


def _box(a: np.ndarray, r: int, axes: tuple[int, ...]) -> np.ndarray:
    """Sum over the 2r+1 wide neighbourhood along each axis (clipped at the edges)."""
    for ax in axes:
        n = a.shape[ax]
        c = np.concatenate([np.zeros_like(np.take(a, [0], ax)), np.cumsum(a, ax)], ax)
        hi, lo = np.minimum(np.arange(n) + r + 1, n), np.maximum(np.arange(n) - r, 0)
        a = np.take(c, hi, ax) - np.take(c, lo, ax)
    return a


def numeric_fit(v: np.ndarray, mu: float, lam_cell: float, lam_day: float) -> tuple[np.ndarray, np.ndarray]:
    """(prediction, number of records behind it) for each cell of a (y, x, day) array with NaN for missing."""
    ok = ~np.isnan(v)
    r = np.where(ok, v - mu, 0.0)
    okf = ok.astype(float)
    nd, sd = np.rint(_box(okf, SPACE, (0, 1))), _box(r, SPACE, (0, 1))
    day = sd / (nd + lam_day)
    has_day = nd > 0
    # days without any neighbour take the mean effect of the days around
    near_n = _box(has_day.astype(float), TIME, (2,))
    near = _box(np.where(has_day, day, 0.0), TIME, (2,)) / np.maximum(near_n, 1)
    day = np.where(has_day, day, near)
    nc = np.rint(_box(okf, TIME, (2,)))
    cell = _box(np.where(ok, r - day, 0.0), TIME, (2,)) / (nc + lam_cell)
    return mu + day + cell, nd + nc


def category_counts(v: np.ndarray, classes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Records of each class among the day's neighbours and among the cell's days, itself included: (class, y, x, day)."""
    hits = [(v == k).astype(float) for k in classes]
    return np.stack([np.rint(_box(h, SPACE, (0, 1))) for h in hits]), np.stack([np.rint(_box(h, TIME, (2,))) for h in hits])


def class_scores(day: np.ndarray, cell: np.ndarray, model: dict) -> np.ndarray:
    """Log-odds of each class (first axis) from its counts among the day's neighbours and the cell's days."""
    p = np.asarray(model["share"]).reshape(-1, *[1] * (day.ndim - 1))
    x = [np.log((c + PRIOR * p) / (c.sum(0) + PRIOR)) for c in (day, cell)]
    return np.asarray(model["intercept"]).reshape(p.shape) + model["weight"][0] * x[0] + model["weight"][1] * x[1]


def category_fit(v: np.ndarray, classes: tuple[int, ...], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(most likely class, number of records behind it)."""
    day, cell = category_counts(v, classes)
    return np.asarray(classes, float)[np.argmax(class_scores(day, cell, model), 0)], day.sum(0) + cell.sum(0)


def independent(share: list[float]) -> dict:
    """The model before it has seen anything: day and cell speak independently of each other."""
    return {"share": share, "intercept": [-float(np.log(p)) for p in share], "weight": [1.0, 1.0]}


def fit_multinomial(own: np.ndarray, day: np.ndarray, cell: np.ndarray, n: np.ndarray, share: list[float], ridge: float = 1.0, rounds: int = 30) -> dict:
    """Penalised maximum likelihood from ``n`` observed values each: class number ``own``, counts (class, row) of the others."""
    k, start = len(share), independent(share)
    theta0 = np.array([*start["intercept"], *start["weight"]])
    p = np.asarray(share)[:, None]
    x = np.zeros((k, day.shape[1], k + 2))
    for c in range(k):
        x[c, :, c] = 1.0
    for j, counts in enumerate((day, cell)):
        x[:, :, k + j] = np.log((counts + PRIOR * p) / (counts.sum(0) + PRIOR))
    seen, theta = x[own, np.arange(len(own))], theta0.copy()

    def loss(t: np.ndarray) -> float:
        z = x @ t
        top = z.max(0)
        return float((n * (np.log(np.exp(z - top).sum(0)) + top - seen @ t)).sum() + ridge / 2 * ((t - theta0) ** 2).sum())

    now = loss(theta)
    for _ in range(rounds):
        z = x @ theta
        q = np.exp(z - z.max(0))
        q /= q.sum(0)
        mean = np.einsum("kr,kri->ri", q, x)
        grad = n @ (mean - seen) + ridge * (theta - theta0)
        hess = np.einsum("kr,kri,krj->ij", q * n, x, x) - np.einsum("r,ri,rj->ij", n, mean, mean) + ridge * np.eye(k + 2)
        step, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-6 and loss(theta - scale * step) > now:
            scale /= 2
        theta = theta - scale * step
        now = loss(theta)
        if np.abs(scale * step).max() < 1e-8:
            break
    return {"share": share, "intercept": theta[:k].tolist(), "weight": theta[k:].tolist()}


def variance_components(df: DataFrame, fields=FIELDS) -> dict[str, dict]:
    """Per field the model's constants, from all rows: two aggregates by cell and by day, reduced to one row each."""
    nums, cats = [f for f in fields if isinstance(f, Numeric)], [f for f in fields if isinstance(f, Category)]

    def within(keys: list[str]) -> dict:
        g = df.groupBy(*keys).agg(*[x for f in nums for x in (F.count(valid_value(f)).alias(f"n_{f.name}"), F.var_pop(valid_value(f)).alias(f"v_{f.name}"), F.avg(valid_value(f)).alias(f"m_{f.name}"))],
                                  *[F.sum((valid_value(f) == k).cast("long")).alias(f"k_{f.name}_{k}") for f in cats for k in f.classes])
        parts = []
        for f in nums:
            n, v, m = (F.col(f"{x}_{f.name}") for x in "nvm")
            parts += [F.sum(n).alias(f"N_{f.name}"), F.sum(n * v).alias(f"SW_{f.name}"), F.sum(n * m).alias(f"S_{f.name}"), F.sum(n * m * m).alias(f"SS_{f.name}")]
        parts += [F.sum(f"k_{f.name}_{k}").alias(f"K_{f.name}_{k}") for f in cats for k in f.classes]
        return g.agg(*parts).first().asDict()

    by_cell, by_day = within(["iy", "ix"]), within(["time"])
    out: dict[str, dict] = {}
    for f in nums:
        n = by_cell[f"N_{f.name}"] or 0
        if not n:
            out[f.name] = {"mu": 0.0, "lam_cell": 1.0, "lam_day": 1.0}
            continue
        mu = by_cell[f"S_{f.name}"] / n
        total = (by_cell[f"SW_{f.name}"] + by_cell[f"SS_{f.name}"]) / n - mu * mu
        cell, day = max(total - by_cell[f"SW_{f.name}"] / n, 0.0), max(total - by_day[f"SW_{f.name}"] / n, 0.0)
        rest = max(total - cell - day, 1e-6 * max(total, 1e-12), 1e-12)
        out[f.name] = {"mu": mu, "lam_cell": min(rest / max(cell, 1e-12), 1e6), "lam_day": min(rest / max(day, 1e-12), 1e6)}
    for f in cats:
        k = [by_cell[f"K_{f.name}_{c}"] or 0 for c in f.classes]
        out[f.name] = independent([(x + 0.5) / (sum(k) + 0.5 * len(k)) for x in k])
    return out


def fill_missing(df: DataFrame, fields=FIELDS) -> DataFrame:
    """One row per (iy, ix, time) of ``df``: per field its value (filled where possible) and ``<field>_filled``."""
    names = [f.name for f in fields]
    model = variance_components(df, fields)
    epoch = F.lit("1970-01-01").cast("date")
    values = [F.max(valid_value(f)).alias(f.name) for f in fields]
    whole = F.col("iy").isNotNull() & F.col("ix").isNotNull() & F.col("time").isNotNull()
    once = df.groupBy("iy", "ix", "time").agg(*values)
    day = F.datediff(F.to_date("time"), epoch)

    def tiles(d: DataFrame) -> DataFrame:
        """Adds the tiles to which a row belongs, as one of their own or in their halo."""
        for name, c, r, size in (("__ty", "iy", SPACE, TILE), ("__tx", "ix", SPACE, TILE), ("__tt", "__d", TIME, TILE_DAYS)):
            d = d.withColumn(name, F.explode(F.sequence(F.floor((F.col(c) - r) / size).cast("int"), F.floor((F.col(c) + r) / size).cast("int"))))
        return d

    spread = tiles(once.filter(whole).withColumn("__d", day)).select("__ty", "__tx", "__tt", "iy", "ix", "__d", *names)
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("iy", "ix")) + ", __d int, " + ", ".join(f"{n} double, {n}_filled boolean" for n in names)

    cats = [f for f in fields if isinstance(f, Category)]
    origin = lambda ty, tx, tt: (ty * TILE - SPACE, tx * TILE - SPACE, tt * TILE_DAYS - TIME)
    shape = (TILE + 2 * SPACE, TILE + 2 * SPACE, TILE_DAYS + 2 * TIME)

    def places(key: tuple, pdf: pd.DataFrame):
        """Positions of the rows in their tile, and which of them are the tile's own."""
        y, x, d = (pdf[c].to_numpy(np.int64) - o for c, o in zip(("iy", "ix", "__d"), origin(*(int(k) for k in key))))
        return y, x, d, (y >= SPACE) & (y < TILE + SPACE) & (x >= SPACE) & (x < TILE + SPACE) & (d >= TIME) & (d < TILE_DAYS + TIME)

    def observed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """How often each class is seen with each count of classes around it, the value itself left out."""
        y, x, d, inner = places(key, pdf)
        parts = []
        for i, f in enumerate(cats):
            v = np.full(shape, np.nan)
            v[y, x, d] = pdf[f.name].to_numpy(float)
            at = tuple(a[inner & ~np.isnan(v[y, x, d])] for a in (y, x, d))
            own = np.searchsorted(np.asarray(f.classes, float), v[at]) if list(f.classes) == sorted(f.classes) else np.array([f.classes.index(int(c)) for c in v[at]], int)
            day, cell = (c[(slice(None), *at)] for c in category_counts(v, f.classes))
            for c in (day, cell):
                c[own, np.arange(len(own))] -= 1
            seen, n = np.unique(np.vstack([own, day, cell]).astype(int)[:, day.sum(0) + cell.sum(0) > 0], axis=1, return_counts=True)
            parts.append(pd.DataFrame({"f": np.full(len(n), i), "seen": pd.Series(list(seen.T), dtype=object), "n": n}))
        return pd.concat(parts)

    if cats:
        keys = ["__ty", "__tx", "__tt"]
        rows = df.filter(whole).withColumn("__d", day)
        chosen = rows.select(*[F.floor(F.col(c) / size).cast("int").alias(n) for n, c, size in zip(keys, ("iy", "ix", "__d"), (TILE, TILE, TILE_DAYS))]).distinct()
        chosen = chosen.orderBy(F.xxhash64(*keys), *keys).limit(FIT_TILES)
        # repeated rows are merged after the choice, so only the chosen tiles are shuffled
        part = tiles(rows).join(F.broadcast(chosen), keys, "left_semi").groupBy(*keys, "iy", "ix", "__d").agg(*values)
        got = part.groupBy(*keys).applyInPandas(observed, "f int, seen array<int>, n long").groupBy("f", "seen").agg(F.sum("n").alias("n")).collect()
        for i, f in enumerate(cats):
            rows = sorted((tuple(r["seen"]), r["n"]) for r in got if r["f"] == i)
            if rows:
                k, seen = len(f.classes), np.array([r[0] for r in rows])
                model[f.name] = fit_multinomial(seen[:, 0], seen[:, 1: k + 1].T.astype(float), seen[:, k + 1:].T.astype(float), np.array([r[1] for r in rows], float), model[f.name]["share"])

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, d, inner = places(key, pdf)
        at = (y[inner], x[inner], d[inner])
        res = {c: pdf[c].to_numpy()[inner] for c in ("iy", "ix", "__d")}
        for f in fields:
            v = np.full(shape, np.nan)
            v[y, x, d] = pdf[f.name].to_numpy(float)
            m = model[f.name]
            if isinstance(f, Numeric):
                fit, n = numeric_fit(v, m["mu"], m["lam_cell"], m["lam_day"])
                fit = np.clip(fit, f.low, f.high)
            else:
                fit, n = category_fit(v, f.classes, m)
            own = v[at]
            fill = np.isnan(own) & (n[at] > 0)
            res[f.name], res[f"{f.name}_filled"] = np.where(fill, fit[at], own), fill
        return pd.DataFrame(res)

    done = spread.groupBy("__ty", "__tx", "__tt").applyInPandas(tile, schema)
    done = done.select("iy", "ix", F.date_from_unix_date("__d").alias("time"), *[x for n in names for x in (F.when(~F.isnan(n), F.col(n)).alias(n), F.col(f"{n}_filled"))])
    lost = once.filter(~whole)
    lost = lost.select("iy", "ix", F.to_date("time").alias("time"), *[x for n in names for x in (F.col(n), F.lit(False).alias(f"{n}_filled"))])
    return done.unionByName(lost)
