"""Parsing against the strict parser on every record."""

import random

from placeloom.operators import quarantine as q

COLUMNS = ["key", "lat", "lon", "country", "captured", "note"]
CASES = {
    "k,1.5,2,XA,2020-02-29,fine": None,
    "k, 1.5 ,-2,xa,,": None,
    'k,1,2,XA,,"a ""b"", c"': None,
    'k,1,2,XA,,"two\nlines"': None,
    'k,1,2,XA,,"open': "broken_quoting",
    'k,1,2,XA,,"shut" it': "broken_quoting",
    'k,1,2,XA,,in"side': "broken_quoting",
    'k,"1,2,XA': "broken_quoting",
    "k,1,2,XA,": "wrong_column_count",
    "k,1,2,XA,,,": "wrong_column_count",
    "k,91,2,XA,,": "invalid_value",
    "k,1,180.01,XA,,": "invalid_value",
    "k,1e1,2,XA,,": "invalid_value",
    "k,nan,2,XA,,": "invalid_value",
    "k,1,2,XAA,,": "invalid_value",
    "k,1,2,,,": "invalid_value",
    "k,1,2,XA,2021-02-29,": "invalid_value",
    "k,1,2,XA,20210101,": "invalid_value",
}


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, header_row boolean, delimiter string, column_names array<string>")


def test_every_case(spark):
    r = random.Random(1)
    lines = list(CASES) * 20
    r.shuffle(lines)
    rows = [(1, i + 1, x) for i, x in enumerate(lines)] + [(1, 5000, "  "), (1, 5001, None), (1, 1, lines[0])]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "file_id long, line_no int, raw_line string, reason string")
    out = q.parse_records(df, files(spark, [(1, False, ",", COLUMNS)] * 2), COLUMNS).collect()
    assert len(out) == len(lines)
    assert all(x.reason == CASES[lines[x.line_no - 1]] for x in out)
    first = next(x for x in out if lines[x.line_no - 1].startswith("k,1.5"))
    assert (first.lat, first.lon, str(first.captured), first.note) == (1.5, 2.0, "2020-02-29", "fine")
    assert next(x for x in out if "two" in lines[x.line_no - 1]).note == "two\nlines"


def test_delimiters_headers_and_strangers(spark):
    text = {1: ["", "Key;Lat;Lon;Country", "a;1;2;XA", "b;1,5;2;XA", "c;1.5;2;XA"], 2: ["a|1|2|XA", "b|1|2|XA|x"], 3: ["a\t1\t2\tXA", "\t\t\t"], 4: ["alone"]}
    df = spark.createDataFrame([(f, i + 1, x) for f, v in text.items() for i, x in enumerate(v)], "file_id long, line_no int, raw_line string")
    four = ["key", "lat", "lon", "country"]
    spec = files(spark, [(1, True, None, None), (2, False, None, four), (3, False, None, four)])
    got = {(x.file_id, x.line_no): x.reason for x in q.parse_records(df, spec, four).collect()}
    assert got == {(1, 3): None, (1, 4): "invalid_value", (1, 5): None, (2, 1): None, (2, 2): "wrong_column_count", (3, 1): None, (3, 2): "invalid_value", (4, 1): "wrong_column_count"}


def test_empty_and_long(spark):
    lines = "file_id long, line_no int, raw_line string"
    spec = files(spark, [(1, False, ",", ["key", "note"])])
    assert q.parse_records(spark.createDataFrame([], lines), spec, ["key"]).count() == 0
    long = "k," + "x" * 300_000
    out = q.parse_records(spark.createDataFrame([(1, 1, long), (1, 2, long)], lines), spec, ["key", "note"]).collect()
    assert [x.reason for x in out] == [None, None] and len(out[0].note) == 300_000
