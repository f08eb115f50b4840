"""Scalar functions on written-out cases, and operators that no SQL covers."""

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import relational, search
from placeloom.plans.confidence import fit_logistic, rate
from placeloom.sources import readers, writers
from placeloom.streaming.reverse import PING, reverse_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("elm rd n", "elm road north"), ("st osyth ln", "st osyth lane"), ("9 st bride sq", "9 st bride square"), ("thirty second ln", "32nd lane"), ("third blvd", "3rd boulevard"), ("second hand books", "second hand books"), ("eleventh rd", "11th road")],
)
def test_expansion(spark, given, want):
    assert one(spark, text.expand_abbreviations(F.lit(given))) == want


def test_keys(spark):
    assert one(spark, text.search_key(F.lit("Straße des Ø-Æro, 5b"))) == "strasse des o aero 5b"
    assert one(spark, text.search_key(F.lit(" .,"))) is None
    assert one(spark, text.street_text(F.lit("old quarry se"))) == "old quarry southeast"
    assert one(spark, text.base_number(F.lit("88 3/4"))) == 88
    assert one(spark, text.normal_url(F.lit("HTTPS://www.Example.org/a/"))) == "example.org/a"
    assert one(spark, text.last_nine_digits(F.lit("+49 30 1234567"))) == "301234567"


def test_classes_and_licences(spark):
    assert [one(spark, text.road_class(F.lit(h))) for h in ("bridleway", "footway", "trunk_link", "corridor")] == [13, 13, 1, 16]
    terms = lambda t: one(spark, text.licence_terms(F.lit(t)))
    assert [terms(t) for t in ("CC-BY-NC-ND 4.0", "https://creativecommons.org/licenses/by-nd/3.0/", "CC BY-NC 2.0", "For non-commercial use", "ODbL 1.0", "by nc ferries")] == ["restricted", "restricted", "non_commercial", "non_commercial", "permitted", "permitted"]
    assert one(spark, text.licence_terms(F.lit("CC BY-NC 2.0"), F.lit("CC BY-NC 2.0 "), F.lit("permitted"))) == "permitted"


def test_hilbert_neighbours_and_spread(spark):
    rows = [(x, y) for x in range(16) for y in range(16)]
    df = spark.createDataFrame([(x * 2**28 - 1_800_000_000, y * 2**27 - 900_000_000) for x, y in rows], "lon long, lat long")
    keys = [r.k for r in df.select(geo.hilbert_key(F.col("lon"), F.col("lat")).alias("k")).collect()]
    assert len(set(keys)) == len(rows)
    order = [p for _, p in sorted(zip(keys, rows))]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:]))


def test_geohash(spark):
    assert one(spark, geo.geohash(F.lit(57.64911), F.lit(10.40744), 6)) == "u4pruy"


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(40, 40), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in relational.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(15)}, **{i: 15 for i in range(15, 31)}, 40: 40}


def test_lowest_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("b", 2)], "g string, v int")
    got = sorted((r.g or "", r.v, r["rank"]) for r in relational.lowest_per_group(df, ["g"], ["v"], 3).collect())
    assert got == [("", 1, 1), ("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 2, 1)]


def test_typo_expansion(spark):
    words = spark.createDataFrame([("strret",), ("street",), ("ab",), ("aoad",)], "word string")
    vocabulary = spark.createDataFrame([("street", 5), ("strret1", 2), ("road", 3)], "term string, n long")
    assert {(r.word, r.correction) for r in search.typo_expansion(words, vocabulary).collect()} == {("strret", "street")}


def test_logistic_learns(spark):
    rows = [(i % 2, int(i % 10 < 8) if i % 2 else int(i % 10 < 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "f int, y int")
    w = fit_logistic(df, ["f"], "y")
    p = {r.f: r.p for r in df.withColumn("p", rate(w, ["f"])).select("f", "p").distinct().collect()}
    assert abs(p[1] - 0.8) < 0.03 and abs(p[0] - 0.2) < 0.03
    assert fit_logistic(df.limit(0), ["f"], "y").tolist() == [0, 0]


def test_readers_and_publish(spark, tmp_path):
    import zipfile

    good = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"number":"7","street":"Main"}}'
    (tmp_path / "a.geojson").write_text(f"{good}\n\nbroken{{\n")
    rows, bad = readers.geojson_lines(spark, str(tmp_path / "a.geojson"))
    assert [(r.number, r.street, r.lon, r.lat) for r in rows.collect()] == [("7", "Main", 1.5, 2.5)]
    assert [r.line for r in bad.collect()] == ["broken{"]
    (tmp_path / "a.csv").write_text("Lon,LAT,Number,STREET\n1,x,3,Oak\n")
    r = readers.address_csv(spark, str(tmp_path / "a.csv")).first()
    assert (r.lon, r.lat, r.number, r.street, r.unit) == (1.0, None, "3", "Oak", None)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in/x.txt", "l1\r\nl2\n")
    assert [r.line for r in readers.zip_entry_lines(spark, str(tmp_path / "c.zip"), "in/x.txt").collect()] == ["l1", "l2"]
    (tmp_path / "q.csv").write_text("Entity,QRank\nQ5,100\nQ5,90\nbad,1\n")
    assert [(r.item, r.views) for r in readers.view_ranks(spark, str(tmp_path / "q.csv")).collect()] == [(5, 100)]
    root = f"file://{tmp_path}/pack"
    writers.publish(spark.range(3), root)
    writers.publish(spark.range(5), root)
    assert writers.published(spark, root).count() == 5
    base = spark.createDataFrame([(1, "x", None)], "id long, LAT string, other string")
    hit = spark.createDataFrame([(1, 1.0, 2.0)], "id long, lat double, lon double")
    assert writers.with_coordinates(base, hit, "id").collect()[0].asDict() == {"id": 1, "LAT": 1.0, "other": None, "lon": 2.0}


def test_stream(spark, tmp_path):
    pings = spark.createDataFrame([(1, None, None, "c", 10.0, 50.0, 1.0, None), (2, None, None, "c", 11.0, 50.0, 1.0, None)], PING)
    pings.coalesce(1).write.parquet(f"{tmp_path}/in")
    places = spark.createDataFrame([(7, 10.0001, 50.0)], "rec_id long, lon double, lat double")
    reverse_stream(spark, f"{tmp_path}/in", places, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [(r.ping_id, r.rec_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 7)]
