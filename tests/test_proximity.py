"""Near points and containment against measuring every pair."""

import math
import random

import numpy as np

from placeloom.operators import proximity


def metres(a, b):
    (x, y), (u, v) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * proximity.EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_near_points_everywhere(spark):
    r = random.Random(5)
    centres = [(10.0, 50.0), (179.9999, 12.0), (-180.0, -60.0), (0.0, 89.9999), (33.0, -89.9998), (-0.00001, 0.00001), (77.0, 90.0)]
    spread = lambda c: ((c[0] + r.uniform(-4e-4, 4e-4) / max(0.01, math.cos(math.radians(c[1]))) + 180) % 360 - 180, max(-90.0, min(90.0, c[1] + r.uniform(-4e-4, 4e-4))))
    a = [(i, *spread(r.choice(centres))) for i in range(150)]
    b = [(i, *spread(r.choice(centres))) for i in range(150)]
    dirt = [(900, None, 1.0), (901, 0.0, 0.0), (902, 200.0, 0.0), (903, float("nan"), 1.0), (None, 10.0, 50.0)]
    schema = "key long, lon double, lat double, _cell string"
    left = spark.createDataFrame([(*x, "c") for x in a + dirt + a[:5]], schema)
    right = spark.createDataFrame([(*x, "c") for x in b + dirt], schema.replace("key", "rec"))
    got = proximity.near_points(left, right, 30.0, "key", "rec", with_distance=True).collect()
    want = {(i, j) for i, *p in a for j, *q in b if metres(p, q) <= 30}
    assert {(x.key, x.rec) for x in got} == want and len(got) == len(want)
    by = {i: p for i, *p in a}, {i: p for i, *p in b}
    assert all(abs(x.distance_m - metres(by[0][x.key], by[1][x.rec])) < 1e-3 for x in got)
    plain = proximity.near_points(left, right, 30.0, "key", "rec").collect()
    assert len(plain) == len(want) and {tuple(x) for x in plain} == want


def test_empty(spark):
    none = spark.createDataFrame([], "key long, lon double, lat double")
    assert proximity.near_points(none, none.withColumnRenamed("key", "rec"), 30.0, "key", "rec").count() == 0


def inside_rings(x, y, edges):
    odd = np.zeros(len(x), bool)
    for x0, y0, x1, y1 in edges:
        if y0 != y1:
            odd ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return odd


def test_regions_on_lines_and_the_date_line(spark):
    """Corners on cell borders, points on edges (inside), rings beyond 180 degrees, many edges."""
    ring = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    many = ring(*[(45 + 10 * math.cos(t), 45 + 10 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 5000, endpoint=False)])
    shapes = [("box", [ring((0, 0), (22.5, 0), (22.5, 22.5), (0, 22.5))]), ("line", [ring((170, -10), (190, -10), (190, 10), (170, 10))]), ("back", [ring((-190, -10), (-170, -10), (-170, 10), (-190, 10))]), ("many", [many])]
    regions = spark.createDataFrame(shapes, "region string, rings array<array<struct<lon: double, lat: double>>>")
    at = {1: (0, 0), 2: (22.5, 10), 3: (11.25, 22.5), 4: (22.6, 10), 5: (179.5, 0), 6: (-179.5, 0), 7: (-170.5, 9.9), 8: (-169.5, 0), 9: (180, 0), 10: (-180, 0), 11: (45, 45), 12: (54.99, 45), 13: (55.01, 45), 14: (45, 54.9), 15: (0, 5)}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "p long, lon double, lat double")
    got = {tuple(r) for r in proximity.points_in_regions(df, regions, "p", "region").collect()}
    both = {(p, r) for p in (5, 6, 7, 9, 10) for r in ("line", "back")}
    assert got == {(2, "box"), (3, "box"), (15, "box"), (11, "many"), (12, "many"), (14, "many")} | both


def test_points_in_regions(spark):
    r = random.Random(7)
    ring = [(2 * math.cos(t) * (1 + 0.4 * math.sin(5 * t)), 2 * math.sin(t)) for t in np.linspace(0, 2 * math.pi, 40, endpoint=False)]
    hole = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
    points = [(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(400)]
    shape = [[{"lon": x, "lat": y} for x, y in part] for part in (ring, hole)]
    regions = spark.createDataFrame([("star", shape), ("none", None), ("thin", [[{"lon": 0.0, "lat": 0.0}]])], "region string, rings array<array<struct<lon: double, lat: double>>>")
    df = spark.createDataFrame(points + points[:3], "p long, lon double, lat double")
    got = {tuple(x) for x in proximity.points_in_regions(df, regions, "p", "region").collect()}
    edges = np.concatenate([np.column_stack([np.array(q), np.roll(np.array(q), -1, 0)]) for q in (ring, hole)])
    inside = inside_rings(np.array([p[1] for p in points]), np.array([p[2] for p in points]), edges)
    assert got == {(p[0], "star") for p, yes in zip(points, inside) if yes}
