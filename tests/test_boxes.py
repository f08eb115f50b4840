"""Boxes of localities on the date line and of wide ones."""

from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import proximity
from placeloom.plans import build_queries


def test_boxes_over_the_date_line_and_wide_ones(spark, tmp_path):
    """j4, a6: a locality on the date line and one with a stray address keep their boxes."""
    rows = [(1, "line", 179.98, 10.0), (2, "line", -179.97, 10.02), (3, "stray", 5.0, 50.0), (4, "stray", 45.0, 51.0), (5, "small", 6.0, 50.5), (6, "small", 6.1, 50.6)]
    pings = [(1, -179.99, 10.01), (2, 180.0, 10.01), (3, 0.0, 10.01), (4, 30.0, 50.5), (5, 6.05, 50.55), (6, -180.0, 10.01), (7, 179.97, 10.01)]
    spark.createDataFrame(pings, "ping_id long, lon double, lat double").write.parquet(f"{tmp_path}/pings.parquet")
    real = build_queries.addresses
    build_queries.addresses = lambda s, sf, *c: s.createDataFrame(rows, "rec_id long, locality string, lon double, lat double")
    try:
        got = {tuple(r) for r in build_queries.j4(spark, str(tmp_path)).collect()}
        best = {tuple(r) for r in build_queries.a6(spark, str(tmp_path)).collect()}
        mean = {r.locality: r.lon for r in build_queries.locality_points(spark, "").collect()}
    finally:
        build_queries.addresses = real
    assert got == {(1, "line"), (2, "line"), (6, "line"), (4, "stray"), (5, "stray"), (5, "small")}
    assert best == {(1, "line", False), (2, "line", False), (6, "line", False), (4, "stray", False), (5, "small", True)}
    assert abs(mean["line"] + 179.995) < 1e-6 and abs(mean["small"] - 6.05) < 1e-9


def test_box_margin_reaches_over_the_date_line(spark):
    box = spark.createDataFrame([("a", -180.0005, 0.0, -179.0, 1.0)], "r string, w double, s double, e double, n double")
    rings = box.select("r", geo.box_rings(*[F.col(c) for c in "wsen"]).alias("rings"))
    at = spark.createDataFrame([(1, 179.9999, 0.5), (2, -179.5, 0.5), (3, 179.99, 0.5)], "p long, lon double, lat double")
    assert {r.p for r in proximity.points_in_regions(at, rings, "p", "r").collect()} == {1, 2}
