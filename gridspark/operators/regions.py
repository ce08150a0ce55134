"""Points in regions and points near points.

Regions are simple polygons, with holes or in several parts, cut into triangles by ear clipping. Points and triangles are spread over the cluster
by the leaves of a bounding-volume hierarchy over the plane: each point goes to one leaf, each triangle to the
leaves its box meets. Inside a leaf a second hierarchy over the triangles' boxes gives each point its candidate
triangles, which are tested exactly. All triangles of a region that meet a leaf stay together, so a point that
lies on the edge between two triangles of a region is found once without another shuffle; a point on the boundary
shared by two regions goes to the smaller region key where one region per point is asked for.

The upper hierarchy is planned from hash samples of at most ``PLAN_POINTS`` points and only decides where rows go,
never whether they count. Its leaves are counted; those with more than ``LEAF_POINTS`` points or ``LEAF_TRIANGLES``
triangles are split again at their own medians, from a sample of their own points, until none is left or nothing can
be told apart. So the leaves grow in number, not in size, and a point is sent to one task at any size of the data. Only
a place that no cut divides (triangles that all lie over one another) is split into blocks, its points by its regions,
so no task gets an unbounded group.

Points near points: the disc of the given radius around each distinct position is a region, drawn as an octagon
that encloses it (beyond 80 degrees its exact box, of full width where it holds a pole; with a second copy across the date line), so the
search is the same; an exact great-circle test follows.

Defined results: rows with a NULL, NaN or infinite coordinate (for positions: outside the valid ranges too) have no
position and never appear; equal positions are searched once and their ids expanded afterwards; a repeated
(id, position) counts once; a polygon of fewer than three distinct points is empty; one that crosses itself is an
error that names it (``broken_regions`` lists them beforehand); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.missing import finite
from gridspark.session import cut_lineage

EARTH_KM = 6371.0
PLAN_POINTS = 1_000_000
LEAF_POINTS, LEAF_TRIANGLES = 50_000, 200_000
#: sampled points behind a leaf of the plan, at least
PER_LEAF = 16
ROUNDS = 8
FAN = 8


# --- geometry -------------------------------------------------------------------------------------------------

class _Reflex:
    """The vertices at which a polygon is not convex, in the squares of a grid; those that become convex are skipped."""

    def __init__(self, xs: list[float], ys: list[float], flags: list[bool]):
        self.flags = flags
        self.x0, self.y0 = min(xs), min(ys)
        self.live = [i for i, f in enumerate(flags) if f]
        n = max(1, int(math.sqrt(len(self.live))))
        self.sx, self.sy = ((max(v) - min(v)) / n or 1.0 for v in (xs, ys))
        self.cells: dict[tuple[int, int], list[int]] = {}
        for i in self.live:
            self.cells.setdefault((int((xs[i] - self.x0) / self.sx), int((ys[i] - self.y0) / self.sy)), []).append(i)

    def within(self, x1: float, y1: float, x2: float, y2: float) -> Iterator[int]:
        i1, i2, j1, j2 = int((x1 - self.x0) / self.sx), int((x2 - self.x0) / self.sx), int((y1 - self.y0) / self.sy), int((y2 - self.y0) / self.sy)
        if (i2 - i1 + 1) * (j2 - j1 + 1) > len(self.live):
            self.live = [k for k in self.live if self.flags[k]]
            yield from self.live
            return
        for i in range(i1, i2 + 1):
            for j in range(j1, j2 + 1):
                for k in self.cells.get((i, j), ()):
                    if self.flags[k]:
                        yield k


def ear_clip(xs: list[float], ys: list[float]) -> list[tuple[int, int, int]]:
    """Triangles (index triples) of a simple polygon, either orientation, convex or not.

    Only reflex vertices near a candidate ear can spoil it, so the work is near to linear for usual shapes. A polygon
    that crosses itself is a ValueError: it leaves no ear, or triangles whose areas don't add up to its own.
    """
    n = len(xs)
    if n > 1 and (xs[0], ys[0]) == (xs[-1], ys[-1]):
        n -= 1
    idx = [i for i in range(n) if (xs[i], ys[i]) != (xs[i - 1 if i else n - 1], ys[i - 1 if i else n - 1])]
    if len(idx) < 3:
        return []
    area = sum(xs[idx[k - 1]] * ys[idx[k]] - xs[idx[k]] * ys[idx[k - 1]] for k in range(len(idx)))
    if area < 0:
        idx.reverse()

    def cross(a: int, b: int, c: int) -> float:
        return (xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a])

    after, before = dict(zip(idx, [*idx[1:], idx[0]])), dict(zip(idx, [idx[-1], *idx[:-1]]))
    flags = [False] * len(xs)
    for i in idx:
        flags[i] = cross(before[i], i, after[i]) <= 0
    reflex = _Reflex(xs, ys, flags)

    def spoiled(a: int, b: int, c: int) -> bool:
        corners = ((xs[a], ys[a]), (xs[b], ys[b]), (xs[c], ys[c]))
        for p in reflex.within(min(xs[a], xs[b], xs[c]), min(ys[a], ys[b], ys[c]), max(xs[a], xs[b], xs[c]), max(ys[a], ys[b], ys[c])):
            if p not in (a, b, c) and cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 and (xs[p], ys[p]) not in corners:
                return True
        return False

    out, b, left, stuck = [], idx[0], len(idx), 0
    while left > 3:
        if stuck > left:
            raise ValueError("the polygon crosses itself")
        a, c = before[b], after[b]
        turn = cross(a, b, c)
        if turn >= 0 and not (turn > 0 and spoiled(a, b, c)):
            if turn > 0:
                out.append((a, b, c))
            after[a], before[c] = c, a
            flags[b] = False
            for v in (a, c):
                flags[v] = flags[v] and cross(before[v], v, after[v]) <= 0
            left, stuck = left - 1, 0
        else:
            stuck += 1
        b = c  # on to the next one, so that triangles don't all share a corner
    a, c = before[b], after[b]
    if cross(a, b, c) != 0:
        out.append((a, b, c))
    total = sum(abs(cross(*t)) for t in out)
    # coordinates of this size carry rounding errors of this size
    scale = max(max(map(abs, xs)), max(map(abs, ys)), 1e-300)
    if abs(total - abs(area)) > 1e-9 * total + 1e-14 * scale * scale * n:
        raise ValueError("the polygon crosses itself")
    return out


def _ring(xs: list[float], ys: list[float], left: bool) -> list[tuple[float, float]]:
    """The ring's points without its repeated end, running left (counter-clockwise) or right round."""
    p = list(zip(xs, ys))
    p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
    area = sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p)))
    return p if (area > 0) == left else p[::-1]


def _opens(ring: list[tuple[float, float]], i: int, to: tuple[float, float]) -> bool:
    """Whether the way from corner ``i`` of a ring that runs left to ``to`` starts inside it."""
    at, a, b = ring[i], ring[i - 1], ring[(i + 1) % len(ring)]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if side(a, at, b) > 0:
        return side(at, to, a) > 0 and side(to, at, b) > 0
    return not (side(at, to, b) >= 0 and side(to, at, a) >= 0)


def bridge_holes(xs: list[float], ys: list[float], holes: list[tuple[list[float], list[float]]]) -> tuple[list[float], list[float]]:
    """One ring for a polygon with holes: each hole is tied in at its rightmost point by a bridge to a corner that this
    point can see, so that ear clipping applies. A hole that lies outside is a ValueError."""
    ring = _ring(xs, ys, True)
    rings = [r for r in (_ring(list(x), list(y), False) for x, y in holes) if len(set(r)) >= 3]
    for hole in sorted(rings, key=max, reverse=True):
        k = hole.index(max(hole))
        mx, my = hole[k]
        # the first edge that a ray to the right meets
        best, corner = math.inf, -1
        for i in range(len(ring)):
            (ax, ay), (bx, by) = ring[i - 1], ring[i]
            if min(ay, by) <= my <= max(ay, by) and ay != by:
                at = ax + (my - ay) * (bx - ax) / (by - ay)
                # ring's edges run upwards where its inside is on their left
                if mx <= at < best and by > ay:
                    best, corner = at, (i - 1) % len(ring) if ax > bx else i
        if corner < 0:
            raise ValueError("a hole lies outside its polygon")
        cx, cy = ring[corner]
        if (cx, cy) != (best, my):
            # a corner within the triangle of point, edge and corner hides the corner: the one nearest to the ray is seen
            seen = None
            for i, (x, y) in enumerate(ring):
                if (x, y) == (cx, cy) or x < mx:
                    continue
                d = [(best - mx) * (y - my), (cx - best) * (y - my) - (cy - my) * (x - best), (mx - cx) * (y - cy) - (my - cy) * (x - cx)]
                (ax, ay), (bx, by) = ring[i - 1], ring[(i + 1) % len(ring)]
                reflex = (x - ax) * (by - ay) - (y - ay) * (bx - ax) <= 0
                if reflex and (all(v >= 0 for v in d) or all(v <= 0 for v in d)):
                    slope = (abs(y - my) / max(x - mx, 1e-300), x)
                    if seen is None or slope < seen[0]:
                        seen = slope, i
            corner = seen[1] if seen else corner
        # of corners at the same place (ends of earlier bridges) the one whose inner angle opens towards the hole
        corner = next((i for i, at in enumerate(ring) if at == ring[corner] and _opens(ring, i, (mx, my))), corner)
        ring = [*ring[: corner + 1], *hole[k:], *hole[: k + 1], *ring[corner:]]
    return [x for x, _ in ring], [y for _, y in ring]


class BoxTree:
    """Hierarchy of bounding boxes over triangles; levels of ``FAN`` children, built by recursive median order."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.order = _median_order((lo + hi) / 2)
        self.levels = [(lo[self.order], hi[self.order])]
        while len(self.levels[-1][0]) > FAN:
            a, b = self.levels[-1]
            at = np.arange(0, len(a), FAN)
            self.levels.append((np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)))

    def candidates(self, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) index pairs whose box holds the point."""
        top = len(self.levels[-1][0])
        p, node = np.repeat(np.arange(len(pts)), top), np.tile(np.arange(top), len(pts))
        for k in range(len(self.levels) - 1, -1, -1):
            lo, hi = self.levels[k]
            ok = (pts[p] >= lo[node]).all(1) & (pts[p] <= hi[node]).all(1)
            p, node = p[ok], node[ok]
            if k:
                size = len(self.levels[k - 1][0])
                p, node = np.repeat(p, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                ok = node < size
                p, node = p[ok], node[ok]
        return p, self.order[node]


def _median_order(c: np.ndarray) -> np.ndarray:
    """Order of the rows in which runs of FAN, FAN^2, ... are compact: halves by the median of the wider axis."""
    out, todo = [], [np.arange(len(c))]
    while todo:
        i = todo.pop()
        if len(i) <= FAN:
            out.append(i)
            continue
        axis = int(np.argmax(np.ptp(c[i], axis=0)))
        half = max(FAN, (len(i) // 2) // FAN * FAN)
        i = i[np.argsort(c[i, axis], kind="stable")]
        todo += [i[half:], i[:half]]
    return np.concatenate(out) if out else np.zeros(0, int)


def in_triangle(p: np.ndarray, t: np.ndarray, slack: float) -> np.ndarray:
    """Whether p (n, 2) lies in or on t (n, 6); ``slack`` is the tolerance in units of the triangle's size."""
    s = []
    for a, b in ((0, 2), (2, 4), (4, 0)):
        s.append((t[:, b] - t[:, a]) * (p[:, 1] - t[:, a + 1]) - (t[:, b + 1] - t[:, a + 1]) * (p[:, 0] - t[:, a]))
    s = np.stack(s)
    area = np.abs(s.sum(0))
    eps = slack * np.maximum(area, np.finfo(float).tiny)
    return (s >= -eps).all(0) | (s <= eps).all(0)


# --- upper hierarchy ------------------------------------------------------------------------------------------

class Plan:
    """Binary splits of the plane; leaves are numbered from 0, the number of a leaf that is split again is free."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.kids, self.leaves = [], [], [], 0
        self._at: dict[int, int] = {}
        self._build(sample, leaves)
        self._freeze()

    def _freeze(self) -> None:
        self.table = np.array(self.axis), np.array(self.cut), np.array(self.kids).reshape(-1, 2)

    def _node(self) -> int:
        self.axis.append(-1), self.cut.append(0.0), self.kids.append((0, 0))
        return len(self.axis) - 1

    def _leaf(self, node: int) -> None:
        self.kids[node] = (self.leaves, self.leaves)
        self._at[self.leaves] = node
        self.leaves += 1

    def _build(self, pts: np.ndarray, leaves: int, node: int | None = None) -> int:
        node = self._node() if node is None else node
        found = self._halves(pts) if leaves > 1 else None
        if found is None:
            self._leaf(node)
            return node
        axis, cut = found
        left = pts[:, axis] < cut
        a = self._build(pts[left], leaves // 2)
        b = self._build(pts[~left], leaves - leaves // 2)
        self.axis[node], self.cut[node], self.kids[node] = axis, cut, (a, b)
        return node

    @staticmethod
    def _halves(pts: np.ndarray) -> tuple[int, float] | None:
        """(axis, value) nearest to halving the points, on the wider axis if that one can be cut."""
        if len(pts) < 2:
            return None
        for axis in np.argsort(-np.ptp(pts, axis=0)):
            v = np.sort(pts[:, axis])
            cut = v[len(v) // 2]
            if cut == v[0]:  # more than half share the smallest value
                cut = v[min(int(np.searchsorted(v, cut, "right")), len(v) - 1)]
            if cut > v[0]:
                return int(axis), float(cut)
        return None

    def split(self, leaf: int, sample: np.ndarray, leaves: int) -> bool:
        """Cut a leaf at its own medians; False if its points can't be told apart."""
        if leaves < 2 or self._halves(sample) is None:
            return False
        self._build(sample, leaves, self._at.pop(leaf))
        self._freeze()
        return True

    def boxes(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of the boxes and the leaves they meet; a point is a box of no size."""
        axis, cuts, kids = self.table
        row, node, rows, leaf = np.arange(len(lo)), np.zeros(len(lo), int), [], []
        while len(row):
            end = axis[node] < 0
            rows.append(row[end]), leaf.append(kids[node[end], 0])
            row, node = row[~end], node[~end]
            ax, cut = axis[node], cuts[node]
            go_l, go_r = lo[row, ax] < cut, hi[row, ax] >= cut
            row, node = np.concatenate([row[go_l], row[go_r]]), np.concatenate([kids[node[go_l], 0], kids[node[go_r], 1]])
        return (np.concatenate(rows), np.concatenate(leaf)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _sample(points: DataFrame, n: int, want: int) -> pd.DataFrame:
    """About ``want`` of the ``n`` points, by hash."""
    keep = min(1.0, want / max(n, 1))
    if keep < 1:
        points = points.filter(F.pmod(F.xxhash64("x", "y"), F.lit(1_000_000_000)) < int(keep * 1_000_000_000))
    return points.toPandas()


def plan_leaves(points: DataFrame, triangles: DataFrame) -> tuple[Plan, dict[int, int], dict[int, int]]:
    """(hierarchy, points per leaf, triangles per leaf) for ``points`` (x, y) and ``triangles`` (x1 .. y3)."""
    n, n_tri = points.count(), triangles.count()
    # also small inputs get enough leaves to keep a machine busy
    leaves = math.ceil(max(2 * n / LEAF_POINTS, 3 * n_tri / LEAF_TRIANGLES, min(32, n / 256)))
    pts = _sample(points.select("x", "y"), n, min(PLAN_POINTS, 4 * PER_LEAF * leaves)).to_numpy(float).reshape(-1, 2)
    plan, fixed = Plan(pts, max(1, min(leaves, len(pts) // PER_LEAF))), set()
    for _ in range(ROUNDS):
        p, t = place_points(points.select("x", "y"), plan), place_triangles(triangles.select(*CORNERS), plan)
        count = lambda d: {r["leaf"]: r["count"] for r in d.groupBy("leaf").count().collect()}
        n_p, n_t = count(p), count(t)
        need = {k: math.ceil(2 * max(n_p[k] / LEAF_POINTS, n_t[k] / LEAF_TRIANGLES)) for k in n_p.keys() & n_t.keys() - fixed if n_p[k] > LEAF_POINTS or n_t[k] > LEAF_TRIANGLES}
        if not need:
            break
        own = _sample(p.filter(F.col("leaf").isin(list(need))) if len(need) < 1000 else p.join(F.broadcast(p.sparkSession.createDataFrame([(k,) for k in need], "leaf int")), "leaf"),
                      sum(n_p[k] for k in need), min(PLAN_POINTS, 4 * PER_LEAF * sum(need.values())))
        rows = own.groupby("leaf")[["x", "y"]]
        for k, want in need.items():
            at = rows.get_group(k).to_numpy(float) if k in rows.groups else np.zeros((0, 2))
            if not plan.split(k, at, max(2, min(want, len(at) // PER_LEAF)) if len(at) >= 2 else 1):
                fixed.add(k)
    return plan, n_p, n_t


# --- the join -------------------------------------------------------------------------------------------------

def _rings(regions: DataFrame, key: str, xs: str, ys: str, holes: str | None) -> DataFrame:
    holed = F.col(holes).cast("array<struct<xs:array<double>,ys:array<double>>>") if holes else F.lit(None).cast("array<struct<xs:array<double>,ys:array<double>>>")
    return regions.select(F.col(key).alias("rk"), F.col(xs).cast("array<double>").alias("xs"), F.col(ys).cast("array<double>").alias("ys"), holed.alias("holes"))


def _polygon(x, y, holes) -> tuple[list[float], list[float]] | None:
    """One ring of finite coordinates, or None."""
    parts = [(x, y), *((h["xs"], h["ys"]) for h in (holes if holes is not None else []) if h is not None)]
    for a, b in parts:
        if a is None or b is None or len(a) != len(b) or not (np.isfinite(a).all() and np.isfinite(b).all()):
            return None
    return (list(x), list(y)) if len(parts) == 1 else bridge_holes(list(x), list(y), [(list(a), list(b)) for a, b in parts[1:]])


def triangulate(regions: DataFrame, key: str, xs: str = "xs", ys: str = "ys", holes: str | None = None) -> DataFrame:
    """Triangles ``rk, x1, y1, x2, y2, x3, y3`` of polygons given as arrays of coordinates, with ``holes`` (an array of such
    pairs of arrays) cut out. Rows that share a key are parts of one region."""
    kind = regions.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x, y, h in zip(pdf["rk"], pdf["xs"], pdf["ys"], pdf["holes"]):
                try:
                    ring = _polygon(x, y, h)
                    if ring is not None:
                        x, y = ring
                        rows += [(k, x[a], y[a], x[b], y[b], x[c], y[c]) for a, b, c in ear_clip(x, y)]
                except ValueError as e:
                    raise ValueError(f"region {k!r}: {e}") from None
            yield pd.DataFrame(rows, columns=["rk", "x1", "y1", "x2", "y2", "x3", "y3"])

    return _rings(regions, key, xs, ys, holes).filter(F.col("rk").isNotNull()).mapInPandas(cut, f"rk {kind}, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


def broken_regions(regions: DataFrame, key: str, xs: str = "xs", ys: str = "ys", holes: str | None = None) -> DataFrame:
    """``key, reason`` of the polygons that can't be cut into triangles."""
    kind = regions.schema[key].dataType.simpleString()

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x, y, h in zip(pdf["rk"], pdf["xs"], pdf["ys"], pdf["holes"]):
                try:
                    ring = _polygon(x, y, h)
                    reason = "coordinates are missing" if ring is None else None if ear_clip(*ring) else "no area"
                except ValueError as e:
                    reason = str(e)
                if reason:
                    rows.append((k, reason))
            yield pd.DataFrame(rows, columns=["rk", "reason"])

    return _rings(regions, key, xs, ys, holes).mapInPandas(test, f"rk {kind}, reason string").withColumnRenamed("rk", key)


CORNERS = ("x1", "y1", "x2", "y2", "x3", "y3")


def place_points(points: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``leaf``."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf[["x", "y"]].to_numpy(float)
            row, leaf = plan.boxes(at, at)
            yield pdf.iloc[row].assign(leaf=leaf)

    return points.mapInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", leaf int")


def place_triangles(triangles: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``leaf``, a row for each leaf that the triangle's box meets."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = pdf[list(CORNERS)].to_numpy(float).reshape(-1, 3, 2)
            row, leaf = plan.boxes(t.min(1), t.max(1))
            yield pdf.iloc[row].assign(leaf=leaf)

    return triangles.mapInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in triangles.schema) + ", leaf int")


def points_in_triangles(points: DataFrame, triangles: DataFrame, slack: float = 1e-12) -> DataFrame:
    """Distinct pairs ``pk, rk``: points (``pk, x, y``) in or on a region's triangles (``rk, x1 .. y3``).

    Both inputs are read several times (planning, counting, joining); callers cut their lineage where it is long.
    """
    points = points.select("pk", "x", "y").filter(finite(F.col("x")) & finite(F.col("y")) & F.col("pk").isNotNull())
    triangles = triangles.select("rk", *CORNERS)
    plan, n_p, n_t = plan_leaves(points, triangles)
    pk, rk = points.schema["pk"].dataType.simpleString(), triangles.schema["rk"].dataType.simpleString()
    corner = list(CORNERS)
    # a point whose leaf has no triangle, and the other way round, meets nothing
    both = sorted(n_p.keys() & n_t.keys())
    p, t = place_points(points, plan), place_triangles(triangles, plan)
    blocks = {k: (-(-n_p[k] // LEAF_POINTS), -(-n_t[k] // LEAF_TRIANGLES)) for k in both}
    hot = {k: b for k, b in blocks.items() if b != (1, 1)}
    if hot:
        sizes = p.sparkSession.createDataFrame([(k, *hot[k]) for k in sorted(hot)], "leaf int, n_p int, n_t int")
        one = F.lit(1)
        spread = lambda d: d.join(F.broadcast(sizes), "leaf", "left").withColumns({"n_p": F.coalesce("n_p", one), "n_t": F.coalesce("n_t", one)})
        p = spread(p).withColumn("pb", F.pmod(F.xxhash64("pk"), F.col("n_p")).cast("int")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1))).drop("n_p", "n_t")
        t = spread(t).withColumn("tb", F.pmod(F.xxhash64("rk"), F.col("n_t")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("n_p") - 1))).drop("n_p", "n_t")
    else:
        p, t = (d.withColumns({"pb": F.lit(0), "tb": F.lit(0)}) for d in (p, t))

    def leaf_join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"pk": a["pk"].iloc[:0], "rk": b["rk"].iloc[:0]})
        if a.empty or b.empty:
            return none
        tri = b[corner].to_numpy(float)
        box = tri.reshape(-1, 3, 2)
        tree, region = BoxTree(box.min(1), box.max(1)), pd.factorize(b["rk"])[0]
        pts, keys_p, keys_r = a[["x", "y"]].to_numpy(float), a["pk"].to_numpy(), b["rk"].to_numpy()
        first = pd.Series(np.arange(len(b))).groupby(region).first().to_numpy()
        parts = []
        for s in range(0, len(pts), 1024):
            i, j = tree.candidates(pts[s: s + 1024])
            ok = in_triangle(pts[s + i], tri[j], slack)
            both = np.unique(np.stack([s + i[ok], region[j[ok]]], 1), axis=0)
            parts.append(pd.DataFrame({"pk": keys_p[both[:, 0]], "rk": keys_r[first[both[:, 1]]]}))
        return pd.concat(parts) if parts else none

    keys = ["leaf", "pb", "tb"]
    return p.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(leaf_join, f"pk {pk}, rk {rk}")


def assign_regions(points: DataFrame, regions: DataFrame, point_key: str, x: str, y: str, region_key: str, holes: str | None = None) -> DataFrame:
    """``point_key, region_key``: the region that holds each point (the smallest key on shared boundaries)."""
    p = points.select(F.col(point_key).alias("pk"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = points_in_triangles(cut_lineage(p), cut_lineage(triangulate(regions, region_key, holes=holes)))
    return pairs.groupBy("pk").agg(F.min("rk").alias("rk")).select(F.col("pk").alias(point_key), F.col("rk").alias(region_key))


def great_circle_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


#: the enclosing octagon of a disc is an affine image of this one, so it is ear-clipped once
_OCT = [(math.cos(math.pi * (2 * k + 1) / 8) / math.cos(math.pi / 8), math.sin(math.pi * (2 * k + 1) / 8) / math.cos(math.pi / 8)) for k in range(8)]
_OCT_TRIANGLES = ear_clip([x for x, _ in _OCT], [y for _, y in _OCT])
_BOX_TRIANGLES = ear_clip([0, 1, 1, 0], [0, 0, 1, 1])


def disc_triangles(positions: DataFrame, radius_km: float) -> DataFrame:
    """Triangles of the regions that enclose the discs around positions (``rk, lat, lon``), in degrees."""
    rad = radius_km / EARTH_KM
    kind = positions.schema["rk"].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lat, lon = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
            reach = np.abs(lat) + 1.2 * math.degrees(rad)
            polar = reach >= 80.0
            # a degree of longitude is shortest at the edge nearest the pole; the margin covers arc against chord
            shrink = np.cos(np.radians(np.minimum(reach, 80.0)))
            delta = math.degrees(rad) * (1.0001 + (rad / shrink) ** 2 / 6)
            wide = delta / shrink
            keys, tris = [], []

            def emit(sel: np.ndarray, xy: np.ndarray) -> None:
                keys.append(pdf["rk"].to_numpy()[sel])
                tris.append(xy)

            sel = np.nonzero(~polar)[0]
            for shift in (0.0, 360.0, -360.0):
                cx = lon[sel] + shift
                s = sel if shift == 0 else sel[(cx + 1.2 * wide[sel] >= -180) & (cx - 1.2 * wide[sel] <= 180)]
                for tri in _OCT_TRIANGLES:
                    emit(s, np.stack([v for k in tri for v in (lon[s] + shift + wide[s] * _OCT[k][0], lat[s] + delta[s] * _OCT[k][1])], 1))
            s = np.nonzero(polar)[0]
            low, high = np.maximum(lat[s] - delta[s], -90.5), np.minimum(lat[s] + delta[s], 90.5)
            # half the width of the disc's box in degrees; all the way round where the disc holds a pole
            whole = np.abs(lat[s]) + delta[s] >= 90
            half = np.where(whole, 180.5, np.degrees(np.arcsin(np.minimum(math.sin(rad) / np.maximum(np.cos(np.radians(lat[s])), 1e-300), 1.0))) * 1.0001 + 1e-9)
            mid = np.where(whole, 0.0, lon[s])
            for shift in (0.0, 360.0, -360.0):
                k = np.arange(len(s)) if shift == 0 else np.nonzero(~whole & (mid + shift + half >= -180) & (mid + shift - half <= 180))[0]
                west, east = mid[k] + shift - half[k], mid[k] + shift + half[k]
                corners = [(west, low[k]), (east, low[k]), (east, high[k]), (west, high[k])]
                for tri in _BOX_TRIANGLES:
                    emit(s[k], np.stack([v for c in tri for v in corners[c]], 1).reshape(-1, 6))
            xy = np.concatenate(tris)
            yield pd.DataFrame({"rk": np.concatenate(keys)} | {c: xy[:, i] for i, c in enumerate(("x1", "y1", "x2", "y2", "x3", "y3"))})

    return positions.select("rk", "lat", "lon").mapInPandas(draw, f"rk {kind}, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")


def _sites(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Distinct ``id, lat, lon, rk`` of the rows that have a position; ``rk`` names the position."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    sites = df.filter(F.col(key).isNotNull() & finite(la) & finite(lo) & la.between(-90, 90) & lo.between(-180, 180))
    sites = sites.select(F.col(key).alias("id"), (la + 0.0).alias("lat"), (lo + 0.0).alias("lon")).distinct()
    return sites.withColumn("rk", F.concat_ws("|", "lat", "lon"))


def near_positions(spots: DataFrame, radius_km: float) -> DataFrame:
    """Pairs ``pk, rk, km`` with pk <= rk of positions (``rk, lat, lon``, distinct) at most ``radius_km`` apart, each with
    itself among them."""
    near = points_in_triangles(spots.select(F.col("rk").alias("pk"), F.col("lon").alias("x"), F.col("lat").alias("y")), disc_triangles(spots, radius_km))
    at = lambda c, i: F.element_at(F.split(c, r"\|"), i).cast("double")
    km = great_circle_km(at("pk", 1), at("pk", 2), at("rk", 1), at("rk", 2))
    return near.filter(F.col("pk") <= F.col("rk")).withColumn("km", km).filter(F.col("km") <= radius_km)


def neighbours(df: DataFrame, key: str, lat: str, lon: str, radius_km: float) -> DataFrame:
    """Distinct pairs ``a, b`` with a < b of different keys at most ``radius_km`` apart, and their distance in km."""
    sites = cut_lineage(_sites(df, key, lat, lon))
    near = near_positions(cut_lineage(sites.select("rk", "lat", "lon").distinct()), radius_km)
    one, two = (sites.select(F.col("rk").alias(k), F.col("id").alias(i)) for k, i in (("pk", "i1"), ("rk", "i2")))
    pairs = near.join(one, "pk").join(two, "rk").filter((F.col("i1") < F.col("i2")) | ((F.col("pk") != F.col("rk")) & (F.col("i1") != F.col("i2"))))
    return pairs.groupBy(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b")).agg(F.min("km").alias("km"))


def neighbour_counts(df: DataFrame, key: str, lat: str, lon: str, radius_km: float) -> DataFrame:
    """Per position with another one at most ``radius_km`` away: ``lat, lon``, ``ids`` on it, ``positions`` and
    ``neighbours`` (ids on them) that near, and ``nearest_km``. Ids that share a position are counted there, never paired."""
    spots = cut_lineage(_sites(df, key, lat, lon).groupBy("rk", "lat", "lon").agg(F.count("*").alias("ids")))
    near = near_positions(spots.select("rk", "lat", "lon"), radius_km).filter("pk <> rk")
    both = near.select(F.col("pk").alias("rk"), F.col("rk").alias("other"), "km").unionByName(near.select("rk", F.col("pk").alias("other"), "km"))
    size = spots.select(F.col("rk").alias("other"), F.col("ids").alias("n"))
    g = both.join(size, "other").groupBy("rk").agg(F.count("*").alias("positions"), F.sum("n").alias("neighbours"), F.min("km").alias("nearest_km"))
    return spots.join(g, "rk").select("lat", "lon", "ids", "positions", "neighbours", "nearest_km")
