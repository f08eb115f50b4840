"""Same addresses in free text, and linked records, on written-out cases."""

import numpy as np
from pyspark.sql import functions as F

from placeloom.llm import addresses, linkage, same_address

STREETS = [("Gudafucombeweg", n) for n in "1 2 3 7 8".split()] + [("Ruddiyoden Court", n) for n in "1 2 17 18".split()] + [("North Fubemaden Road", n) for n in "2 3 4".split()] + [("North Fubemaden Place", n) for n in "2 3 4".split()]
TOWNS = ["Meveham"] * 3 + ["Jezusea"] * 3 + ["Port Calvane"] * 3
SAME = [
    ["Gudafucombeweg 7, 24816 Meveham", "7 gudafucombewg. - meveham", "GUDAFUCOMEWEG 7, 24816", "Meveham, Gudafucombe Weg ７"],
    ["Gudafucombeweg 7 A, 24816 Meveham", "gudafucombeweg 7-a, meveham"],
    ["Flat 9, 17 Ruddiyoden Court, Jezusea, TC1 3DN", "9/17 Ruddiyoden Ct - TC13DN Jezusea", "17 ruddiyoden crt, #9"],
    ["17 Ruddiyoden Court, Jezusea, TC1 3DN", "17 Ruddiyoden, Jezusea"],
    ["2 North Fubemaden Road, Port Calvane", "2 n fubemaden rd, port calvane"],
    ["2 North Fubemaden Place, Port Calvane", "2 N. Fubemaden Pl."],
]
NOISE = [None, "", "?", "North Fubemaden Road", "bakery near Meveham", "12", "7 7 7"]


def test_same_address(spark):
    rows = [(100 * i + j, t, "s") for i, group in enumerate(SAME) for j, t in enumerate(group)] + [(9000 + i, t, "s") for i, t in enumerate(NOISE)] + [(0, SAME[0][0], "s"), (None, SAME[0][0], "s"), (800, SAME[0][0], "s")]
    texts = spark.createDataFrame(rows, "key long, text string, sign string")
    streets = spark.createDataFrame(STREETS, "text string, number string")
    towns = spark.createDataFrame([(t,) for t in TOWNS], "text string")
    got = [tuple(x) for x in same_address.same_address_pairs(texts, streets, towns).collect()]
    classes = [[100 * i + j for j in range(len(g))] + ([800] if i == 0 else []) for i, g in enumerate(SAME)]
    want = {(a, b) for c in classes for a in c for b in c if a < b}
    assert set(got) == want and len(got) == len(want)
    assert same_address.same_address_pairs(texts.limit(0), streets.limit(0), towns.limit(0)).count() == 0


def test_digits_come_first(spark):
    cases = {
        "30-a, voumimond-gss.; meveham; 24813": (["30a"], "", ["24813"]),
        "6 S. Govetuton Pl NF1 6GN": (["6"], "", ["nf16gn"]),
        "29 a dajizibek cres": (["29a"], "", []),
        "12345 Main St, Springfield": (["12345"], "", []),
        "10452 Sunset Blvd, Los Angeles, CA 90077": (["10452"], "", ["90077"]),
        "Hauptstraße 5b, 1010 Wien": (["5b"], "", ["1010"]),
        "Flat 9, 017 Ruddiyoden Court": (["17"], "9", []),
        "9/17 Ruddiyoden Ct": (["17"], "9", []),
        "puerta 7, C/ Kazagulow ５": (["5"], "7", []),
        "no number here": ([], "", []),
        "": ([], "", []),
    }
    df = spark.createDataFrame([(t, "u") for t in cases] + [(None, "u")], "text string, words string").drop("words")
    got = {r.text: (r.numbers, r.unit, r.codes) for r in addresses.numbers_first(df).collect() if r.text is not None}
    assert got == cases


def test_columns_fold_as_texts_do(spark):
    texts = ["Ｓｔｒａßｅ 12​b", "Москва Мain", " Ünter  den\u00a0Línden ", "ﬁne", "É́x", "𝟏𝟐 Main", ""]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(addresses.bare_column(F.col("t")).alias("b")).collect()]
    assert got == [addresses.bare(t) for t in texts]


def test_numbers_of_any_length_and_towns_apart(spark):
    same = [["12345 Gudafucombe Weg, Meveham", "gudafucombeweg 12345 - meveham"], ["1 Ruddiyoden Court, Jezusea", "1 ruddiyoden ct jezusea"], ["1 Ruddiyoden Court, Meveham", "Meveham, 1 Ruddiyoden Crt"], ["Gudafucombeweg 5b, 1010 Meveham", "1010 Meveham, Gudafucombe-weg 5 b"]]
    alone = ["Gudafucombeweg, 24816 Meveham", "24816 Meveham, Gudafucombeweg", "1 Ruddiyoden Court"]
    rows = [(10 * i + j, t) for i, g in enumerate(same) for j, t in enumerate(g)] + [(900 + i, t) for i, t in enumerate(alone)]
    texts = spark.createDataFrame(rows, "key long, text string")
    streets, towns = spark.createDataFrame(STREETS, "text string, number string"), spark.createDataFrame([(t,) for t in TOWNS], "text string")
    codes = spark.createDataFrame([("24816",), (None,)], "text string")
    got = {tuple(x) for x in same_address.same_address_pairs(texts, streets, towns, codes=codes).collect()}
    assert got == {(10 * i, 10 * i + 1) for i in range(len(same))}


def test_links(spark):
    def rec(i, dataset, number, street, town, postcode, lon, lat, unit=None):
        return (i, dataset, number, street, unit, postcode, town, None, lon, lat)

    rows = []
    for h in range(1, 21):
        rows += [rec(h, "osm", str(h), "Ruddiyoden Court", "Jezusea", "TC1 3DN", 10 + h / 1e4, 50.0), rec(100 + h, "a", f" {h} ", "RUDDIYODEN CT", "JEZUSEA", None, 10 + h / 1e4, 50.0001), rec(200 + h, "b", str(h), "Ruddiyoden Road", "Jezusea", "TC1 3DN", 10.02 + h / 1e4, 50.0)]
    rows += [rec(301, "a", "1", "Ruddiyoden Court", "Meveham", "XX1 1XX", 80.0, 20.0), rec(302, "b", "1", "Ruddiyoden Court", "Jezusea", None, None, None, "#4"), rec(303, "b", None, "Ruddiyoden Court", "Jezusea", None, 10.0, 50.0), rec(304, "b", "1", None, None, None, None, None), rec(305, None, "1", "Ruddiyoden Court", "Jezusea", None, 10.0, 50.0), rec(306, "b", "2", "Ruddiyoden Court", None, None, None, None), rec(1, "osm", "1", "Ruddiyoden Court", "Jezusea", "TC1 3DN", 10 + 1 / 1e4, 50.0)]
    df = spark.createDataFrame(rows, "rec long, dataset string, number string, street string, unit string, postcode string, locality string, region string, lon double, lat double")
    got = linkage.link_records(df).collect()
    assert {(x.rec_a, x.rec_b) for x in got} == {(h, 100 + h) for h in range(1, 21)}
    assert all(0.5 <= x.confidence <= 1 for x in got)
    assert linkage.link_records(df.limit(0)).count() == 0


def test_label_model_learns_accuracies():
    r = np.random.default_rng(4)
    truth = r.random(6000) < 0.4
    votes = np.stack([np.where(r.random(6000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.9, 0.8, 0.6)], 1)
    votes = np.column_stack([votes, votes[:, 2]])  # a copy: correlated beyond the class
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = linkage.LabelModel().fit(patterns, counts.astype(float))
    assert set(model.joined) == {2, 4} and any({2, 4} <= set(f) for f in model.factors)
    assert ((model.predict(votes) > 0.5) == truth).mean() > 0.93


def test_vetoes_are_part_of_the_model():
    patterns = np.array([[1, 1, 1], [1, 1, -1], [-1, -1, 1], [-1, -1, -1]])
    model = linkage.LabelModel(vetoes=(2,)).fit(patterns, np.array([500.0, 60.0, 300.0, 200.0]))
    p = model.predict(patterns)
    assert p[0] > 0.9 and p[1] < 0.05 and p[3] < 0.01
