"""Records judged in blocks: no result depends on the block."""

import random

import pyarrow as pa

from placeloom.operators import quarantine as q

COLUMNS = ["key", "lat", "lon", "country", "captured", "note"]
KEYS = ["k", "", "\ufeffk", '"k"', '"k""k"', "k k", "k\r", "\r", 'k"', '"k', '"k" ', "ü\u2028", '"a\r\nb"']
LATS = ["1.5", " 1.5 ", "", "90", "-90.0", "90.01", "1e1", "+7", "nan", ".5", "5.", "\ufeff3", "1.5\n", '"2"', "--1", "\u0661"]
COUNTRIES = ["XA", "xa", "X", "XAA", "", "X1", "XA\r", "éa", '"XA"', " XA"]
DAYS = ["", "2020-02-29", "2021-02-29", "1900-02-29", "2000-02-29", "0000-01-01", "0001-01-01", "9999-12-31", "2020-13-01", "2020-00-10", "2020-04-31", "2020-1-01", "20200101", "2020-01-01\r", "\u0662020-01-01", "2020-01-32", "2020-06-30"]
NOTES = ["", "x", '"a,b"', '"two\nlines"', "x\r", '"open', "a,b", "\x00", "\ufeff"]


def test_every_block_gives_what_each_record_gives():
    r = random.Random(3)
    records = [",".join((r.choice(KEYS), r.choice(LATS), r.choice(LATS), r.choice(COUNTRIES), r.choice(DAYS), r.choice(NOTES))) for _ in range(6000)]
    calm = [f"k{i},1.5,2,XA,2020-02-29,fine" for i in range(4000)]
    records += calm
    r.shuffle(records)
    parser = q.BulkParser(",", COLUMNS, q.LAYOUT, COLUMNS)
    want = [q.diagnose(x, ",", COLUMNS, q.LAYOUT) for x in records]
    assert {w for w, _ in want} == {None, "broken_quoting", "wrong_column_count", "invalid_value"}
    at = 0
    while at < len(records):
        n = r.choice([1, 2, 7, 60, 900])
        reasons, columns, _ = parser.parse(pa.array(records[at : at + n]))
        for i, reason in enumerate(reasons):
            assert reason == want[at + i][0], records[at + i]
            if reason is None:
                assert {c: columns[c][i].as_py() for c in COLUMNS} == want[at + i][1], records[at + i]
        at += n


def test_strict_parser_sees_only_what_fails():
    parser = q.BulkParser(",", ["key", "country"], {"country": "country"}, ["key", "country"])
    records = ["k,XA"] * 500 + ["k,XAA"] + ["k,XA"] * 499 + ["k,XA\r"]
    reasons, _, strict = parser.parse(pa.array(records))
    assert strict == 2 and [i for i, x in enumerate(reasons) if x] == [500, 1000]
    assert q.diagnose("k,XA\r", ",", ["key", "country"], {"country": "country"})[0] == "invalid_value"
