import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.operators import regions
from gridspark.operators.regions import BoxTree, Plan, assign_regions, bridge_holes, broken_regions, ear_clip, in_triangle, neighbour_counts, neighbours, place_points, plan_leaves, triangulate

SCHEMA = "station_id string, lat double, lon double, id string, km string, rk string"


def area(x, y):
    return 0.5 * abs(sum(x[i - 1] * y[i] - x[i] * y[i - 1] for i in range(len(x))))


def test_ear_clip_concave():
    x, y = [0, 4, 4, 3, 3, 1, 1, 0], [0, 0, 3, 3, 1, 1, 3, 3]
    for k in (1, -1):
        t = ear_clip(x[::k], y[::k])
        assert len(t) == 6
        assert sum(area([x[::k][i] for i in p], [y[::k][i] for i in p]) for p in t) == pytest.approx(area(x, y))
    assert ear_clip([0, 1], [0, 1]) == [] and ear_clip([0, 1, 2, 0], [0, 0, 0, 0]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.3, 1.0), min_size=3, max_size=14))
def test_ear_clip_stars(radii):
    n = len(radii)
    x = [r * math.cos(2 * math.pi * k / n) for k, r in enumerate(radii)]
    y = [r * math.sin(2 * math.pi * k / n) for k, r in enumerate(radii)]
    t = ear_clip(x, y)
    assert sum(area([x[i] for i in p], [y[i] for i in p]) for p in t) == pytest.approx(area(x, y), rel=1e-9)


def test_box_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    tri = rng.random((500, 3, 2)) * 0.1 + rng.random((500, 1, 2))
    pts = rng.random((300, 2))
    lo, hi = tri.min(1), tri.max(1)
    i, j = BoxTree(lo, hi).candidates(pts)
    want = (pts[:, None] >= lo).all(2) & (pts[:, None] <= hi).all(2)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(want))))
    ok = in_triangle(np.array([[0.2, 0.2], [0.5, 0.5], [0.6, 0.6]]), np.array([[0, 0, 1, 0, 0, 1]] * 3, float), 1e-12)
    assert ok.tolist() == [True, True, False]


def test_plan_covers_the_plane():
    rng = np.random.default_rng(3)
    p = Plan(rng.random((1000, 2)), 16)
    pts = rng.random((200, 2)) * 3 - 1
    row, leaf = p.boxes(pts, pts)
    assert sorted(row.tolist()) == list(range(200)) and leaf.max() < p.leaves == 16
    row, leaf = p.boxes(np.array([[-9.0, -9.0]]), np.array([[9.0, 9.0]]))
    assert sorted(leaf.tolist()) == list(range(16))


def brute(rows, km):
    ok = {(i, a, o) for i, a, o, *_ in rows if i is not None and a is not None and o is not None and abs(a) <= 90 and abs(o) <= 180}
    out = set()
    for i, a, o in ok:
        for j, b, p in ok:
            if i < j:
                h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
                if 2 * 6371 * math.asin(min(1, math.sqrt(h))) <= km:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("leaf_rows", [50_000, 40])
def test_neighbours(spark, monkeypatch, leaf_rows):
    """Also with tiny leaves, so that leaves are split again and what can't be split goes into blocks."""
    monkeypatch.setattr(regions, "LEAF_POINTS", leaf_rows)
    monkeypatch.setattr(regions, "LEAF_TRIANGLES", leaf_rows)
    rng = np.random.default_rng(7)
    rows = []
    for c, (a, o) in enumerate([(30, -100), (0, 179.99), (0, -179.99), (89.97, 10), (89.99, -170), (-79.9, 50), (-85, 0), (60, 20)]):
        for k in range(25):
            rows.append((f"s{c}_{k}", max(-90.0, min(90.0, a + rng.normal(0, 0.03))), float((o + rng.normal(0, 0.05 / max(math.cos(math.radians(a)), 0.01)) + 180) % 360 - 180), "x", "y", "z"))
    rows += [("same1", 10.0, 10.0, "", "", ""), ("same2", 10.0, 10.0, "", "", ""), ("same1", 10.0, 10.0, "", "", ""), ("far", 10.0, 11.0, "", "", "")]
    rows += [("bad", None, 1.0, "", "", ""), ("bad2", float("nan"), 1.0, "", "", ""), ("bad3", 95.0, 1.0, "", "", ""), ("bad4", 1.0, 500.0, "", "", ""), (None, 10.0, 10.0, "", "", "")]
    got = neighbours(spark.createDataFrame(rows, SCHEMA), "station_id", "lat", "lon", 5.0).select("a", "b").collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    want = brute(rows, 5.0)
    assert {(r.a, r.b) for r in got} == want
    here = {(a, o): {i for i, x, y, *_ in rows if i and x == a and y == o} for i, a, o, *_ in rows if i}
    counts = {(r.lat, r.lon): r for r in neighbour_counts(spark.createDataFrame(rows, SCHEMA), "station_id", "lat", "lon", 5.0).collect()}
    for at, ids in here.items():
        near = {y if x in ids else x for x, y in want if (x in ids) != (y in ids)}
        assert (at in counts) == bool(near)
        assert not near or (counts[at].ids, counts[at].neighbours) == (len(ids), len(near))


def test_regions_and_shared_edges(spark):
    shapes = spark.createDataFrame([("b", [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0]), ("a", [2.0, 4.0, 4.0, 2.0], [0.0, 0.0, 2.0, 2.0]), ("flat", [0.0, 1.0], [0.0, 1.0]), (None, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), ("nul", None, None)], "k string, xs array<double>, ys array<double>")
    pts = spark.createDataFrame([("in_b", 1.0, 1.0), ("edge", 2.0, 1.0), ("out", 5.0, 1.0), ("diag", 3.0, 1.0), ("nan", float("nan"), 0.0), (None, 1.0, 1.0), ("diag", 3.0, 1.0)], "p string, x double, y double")
    assert {tuple(r) for r in assign_regions(pts, shapes, "p", "x", "y", "k").collect()} == {("in_b", "b"), ("edge", "a"), ("diag", "a")}


def test_empty(spark):
    assert neighbours(spark.createDataFrame([], SCHEMA), "station_id", "lat", "lon", 5.0).count() == 0


def test_crossing_polygons_are_reported(spark):
    for x, y in (([0, 2, 2, 0], [0, 2, 0, 2]), ([0, 4, 4, 1, 1, 3, 3, 0], [0, 0, 2, 2, -1, -1, 4, 4])):
        with pytest.raises(ValueError, match="crosses itself"):
            ear_clip(x, y)
    shapes = spark.createDataFrame([("bow", [0.0, 2.0, 2.0, 0.0], [0.0, 2.0, 0.0, 2.0]), ("ok", [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]), ("nul", None, None), ("flat", [0.0, 1.0], [0.0, 1.0])], "k string, xs array<double>, ys array<double>")
    assert {r["k"]: r["reason"] for r in broken_regions(shapes, "k").collect()} == {"bow": "the polygon crosses itself", "nul": "coordinates are missing", "flat": "no area"}
    with pytest.raises(Exception, match="region 'bow'"):
        triangulate(shapes, "k").count()


def test_a_hole_by_a_keyhole():
    x, y = [0, 10, 10, 0, 0, 3, 3, 7, 7, 3], [0, 0, 10, 10, 0, 3, 7, 7, 3, 3]
    x, y = x[:4] + [0] + [3, 3, 7, 7, 3] + [0], y[:4] + [0] + [3, 7, 7, 3, 3] + [0]
    t = ear_clip(x, y)
    assert sum(area([x[i] for i in p], [y[i] for i in p]) for p in t) == pytest.approx(84)


def test_large_polygons_take_little_time():
    import time

    rng = np.random.default_rng(5)
    n = 20_000
    r = 1 + 0.3 * rng.random(n)
    x, y = (r * f(2 * np.pi * np.arange(n) / n) for f in (np.cos, np.sin))
    x, y = x.tolist(), y.tolist()
    start = time.perf_counter()
    t = ear_clip(x, y)
    assert time.perf_counter() - start < 10
    assert sum(area([x[i] for i in p], [y[i] for i in p]) for p in t) == pytest.approx(area(x, y), rel=1e-9)


def test_plan_splits_leaves_again():
    rng = np.random.default_rng(6)
    p = Plan(rng.random((100, 2)), 2)
    dense = np.array([0.1, 0.1]) + rng.random((500, 2)) * 1e-3
    _, leaf = p.boxes(dense, dense)
    assert len(set(leaf.tolist())) == 1 and p.split(int(leaf[0]), dense, 8)
    row, leaf = p.boxes(dense, dense)
    assert len(row) == 500 and len(set(leaf.tolist())) == 8
    assert not p.split(int(leaf[0]), np.zeros((50, 2)), 4)
    same_x = np.stack([np.zeros(64), np.arange(64.0)], 1)
    assert Plan(same_x, 8).leaves == 8


@pytest.mark.parametrize("n", [10_000, 300_000])
def test_copies_do_not_grow_with_the_data(spark, monkeypatch, n):
    """A thousandth of 10 million and of 300 million positions, with leaves a thousandth of the size: every point goes
    to one task, triangles to a bounded number, and no leaf is overfull, though towns are a thousand times denser."""
    monkeypatch.setattr(regions, "LEAF_POINTS", 50)
    monkeypatch.setattr(regions, "LEAF_TRIANGLES", 200)
    monkeypatch.setattr(regions, "PLAN_POINTS", 60_000)
    town = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
    pts = spark.range(n).select("id", F.when(town, 0.3 + u(2) * 0.03).otherwise(u(2)).alias("x"), F.when(town, 0.6 + u(3) * 0.03).otherwise(u(3)).alias("y"))
    # about as many neighbours each, whatever the number of points
    size = F.when(town, F.lit(0.03)).otherwise(F.lit(1.0)) * (2.0 / math.sqrt(n))
    corner = lambda a, b: (F.col("x") + a * size, F.col("y") + b * size)
    tri = pts
    for i, (a, b) in enumerate(((-1, -1), (1, -1), (0, 1)), 1):
        cx, cy = corner(a, b)
        tri = tri.withColumns({f"x{i}": cx, f"y{i}": cy})
    pts = pts.drop("id")
    plan, n_p, n_t = plan_leaves(pts, tri.drop("id", "x", "y"))
    assert sum(n_p.values()) == n == place_points(pts, plan).count()
    blocks = sum(n_p[k] * -(-n_t.get(k, 1) // regions.LEAF_TRIANGLES) for k in n_p) / n
    assert blocks < 1.05 and sum(n_t.values()) / n < 3
    assert max(n_p.values()) <= 2 * regions.LEAF_POINTS


def test_polygons_with_holes():
    """Random stars with round holes: the triangles' area is that of the polygon without the holes."""
    rng = np.random.default_rng(9)
    circle = lambda cx, cy, r, n: ([cx + r * math.cos(2 * math.pi * k / n) for k in range(n)], [cy + r * math.sin(2 * math.pi * k / n) for k in range(n)])
    for _ in range(60):
        n = int(rng.integers(5, 40))
        r = rng.uniform(8, 14, n)
        x, y = (r * f(2 * np.pi * np.arange(n) / n) for f in (np.cos, np.sin))
        spots = [(a, b) for a in (-3.0, 0.0, 3.0) for b in (-3.0, 0.0, 3.0)]
        holes = [circle(*spots[i], rng.uniform(0.3, 1.4), int(rng.integers(3, 9))) for i in rng.choice(9, rng.integers(1, 9), replace=False)]
        holes = [(a[::-1], b[::-1]) if rng.random() < 0.5 else (a, b) for a, b in holes]
        if n < 7 or min(r) * math.cos(math.pi / n) < 6:
            continue
        bx, by = bridge_holes(x.tolist(), y.tolist(), holes)
        t = ear_clip(bx, by)
        want = area(x, y) - sum(area(*h) for h in holes)
        assert sum(area([bx[i] for i in p], [by[i] for i in p]) for p in t) == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError, match="outside"):
        bridge_holes([0, 1, 1, 0], [0, 0, 1, 1], [([5, 6, 6], [0, 0, 1])])


def test_regions_in_parts_and_with_holes(spark):
    kind = "k string, xs array<double>, ys array<double>, holes array<struct<xs:array<double>,ys:array<double>>>"
    shapes = spark.createDataFrame([("a", [0.0, 9.0, 9.0, 0.0], [0.0, 0.0, 9.0, 9.0], [([2.0, 4.0, 4.0, 2.0], [2.0, 2.0, 4.0, 4.0]), ([6.0, 8.0, 7.0], [6.0, 6.0, 8.0])]),
                                    ("a", [20.0, 21.0, 20.0], [0.0, 0.0, 1.0], None), ("b", [2.5, 3.5, 3.5, 2.5], [2.5, 2.5, 3.5, 3.5], [])], kind)
    pts = spark.createDataFrame([("in", 1.0, 1.0), ("hole", 2.2, 2.2), ("b", 3.0, 3.0), ("second", 7.0, 6.5), ("part", 20.2, 0.2), ("out", 15.0, 1.0)], "p string, x double, y double")
    assert {tuple(r) for r in assign_regions(pts, shapes, "p", "x", "y", "k", holes="holes").collect()} == {("in", "a"), ("b", "b"), ("part", "a")}
