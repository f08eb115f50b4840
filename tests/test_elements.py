"""Elements, greedy leaders and reverse layers on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import elements, proximity, search
from placeloom.plans import search_queries


def test_greedy_leaders_are_those_of_a_walk_in_order(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(i, i + 1) for i in range(100, 112)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes = list(range(60)) + list(range(100, 114))
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}
    want: dict[int, int] = {}
    for n in nodes:
        before = [m for m in sorted(near[n]) if m < n and want[m] == m]
        want[n] = before[0] if before else n
    df = spark.createDataFrame([(n, n) for n in nodes], "node long, place long")
    got = elements.greedy_leaders(df, spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()
    assert {x.node: x.leader for x in got} == want and len(got) == len(nodes)
    assert elements.greedy_leaders(df.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_an_address(spark):
    tags = [{"addr:housenumber": " 8 ", "addr:block_number": "10", "addr:quarter": "Q"}, {"addr:housenumber": "1"}, {"addr:street": "S"}, {"addr:housenumber": "1", "addr:place": "P", "addr:village": "V", "addr:city": " "}, {}]
    got = [tuple(x.c)[:6] for x in spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t map<string,string>").orderBy("i").select(elements.address_components(F.col("t")).alias("c")).collect()]
    assert got == [(None, "10-8", None, None, None, None), ("missing_street_or_place", "1", None, None, None, None), ("missing_house_number", None, "S", None, None, None), (None, "1", None, "P", None, "V"), ("missing_house_number", None, None, None, None, None)]


def test_nearest_shapes_however_long(spark):
    """j11, q26: a stretch of a thousand kilometres, one of no length, the date line, ties, and layers in order."""
    lines = [("long", 0.0, 50.0, 14.0, 50.0), ("dot", 20.0, 10.0, 20.0, 10.0), ("dateline", 179.999, 0.0, -179.999, 0.0), ("b", 30.0, 5.0, 30.01, 5.0), ("a", 30.0, 5.0, 30.01, 5.0)]
    at = [(1, 7.1234, 50.0001), (2, 20.0001, 10.0), (3, 180.0, 0.0001), (4, 30.005, 5.0), (5, 7.1234, 50.001), (6, None, 5.0), (7, 30.005, 5.0002)]
    shapes = spark.createDataFrame(lines, "shape_id string, lon double, lat double, lon2 double, lat2 double")
    spots = spark.createDataFrame([("x", 30.005, 5.0001, None, None), ("gone", 999.0, 0.0, None, None)], "shape_id string, lon double, lat double, lon2 double, lat2 double")
    points = spark.createDataFrame(at + at[:2], "p long, lon double, lat double")
    got = {x.p: (x.layer, x.shape_id) for x in proximity.near_shapes(points, [(1, spots), (2, shapes)], 30.0, "p").collect()}
    assert got == {1: (2, "long"), 2: (2, "dot"), 3: (2, "dateline"), 4: (1, "x"), 7: (1, "x")}
    assert proximity.near_shapes(points.limit(0), [(2, shapes.limit(0))], 30.0, "p").count() == 0


def test_unknown_layer_is_an_error(spark):
    with pytest.raises(ValueError, match="address, interpolation, street"):
        search_queries.reverse_ladder(spark, "", spark.range(1), "river")


def test_autocomplete_uses_all_that_is_typed(spark):
    lines = spark.createDataFrame([("old main street meveham", "5"), ("main street meveham", "7"), ("main street meveham", "9"), ("street of main", "1"), (None, "3")], "line string, number string")
    typed = spark.createDataFrame([(1, "main str"), (2, "5 main street mev"), (3, "meveham mai"), (4, "main street mevehamx"), (5, "m"), (6, None), (7, "m 9"), (8, "ma")], "query_id long, key string")
    got = {}
    for x in search.autocomplete(typed, lines).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.name, x.how, x.house))
    got = {k: sorted(v) for k, v in got.items()}
    both = [(1, "main street meveham", 1, 0), (2, "old main street meveham", 1, 0)]
    assert got[1] == both and got[3] == [(r, n, 2, h) for r, n, _, h in both] and got[2] == [(1, "old main street meveham", 1, 1), (2, "main street meveham", 1, 0)]
    assert got[8] == [(1, "main street meveham", 1, 0), (2, "old main street meveham", 1, 0), (3, "street of main", 1, 0)] and set(got) == {1, 2, 3, 8}


def test_rings_are_stitched(spark):
    rows = [("r", "outer", "1", [1, 2], [0.0, 1.0], [0.0, 0.0]), ("r", "outer", "2", [3, 2], [1.0, 1.0], [1.0, 0.0]), ("r", "outer", "3", [3, 4, 1], [1.0, 0.0, 0.0], [1.0, 1.0, 0.0]), ("r", "inner", "9", [7, 8], [0.2, 0.3], [0.2, 0.2])]
    df = spark.createDataFrame(rows, "relation string, role string, way string, refs array<long>, lons array<double>, lats array<double>")
    got = {(x.role, x.closed, x.points, x.area) for x in elements.stitch_rings(df).collect()}
    assert got == {("outer", True, 5, 1.0), ("inner", False, 2, None)}
