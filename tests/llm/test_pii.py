"""Personal information: held-out accuracy on labelled texts, and exact redaction."""

from collections import Counter

from placeloom.llm import pii
from placeloom.llm.pii_training import labelled

GIVEN = frozenset("Hugo Selma Kaspar Nadia Ulrich Greta Pascal Tamara Jonas Miriam".split())


def test_held_out_accuracy():
    detector, right, found, true = pii.train(GIVEN), Counter(), Counter(), Counter()
    texts = list(labelled(sorted(GIVEN), 250, 4711))
    for spans, (_, want) in zip(detector.find([t for t, _ in texts]), texts):
        right.update(k for k, *_ in set(spans) & set(want))
        found.update(k for k, *_ in spans)
        true.update(k for k, *_ in want)
    for kind in pii.KINDS:
        assert right[kind] / found[kind] > 0.97 and right[kind] / true[kind] > 0.97


def test_find_and_redact(spark):
    text = "Author: Hugo Tolberg <hugo.tolberg@mail.example>\n\n    Call 303-555-0147 before the deploy.\n    Parcel sent to 12 Ruvogate Lane, Tegoville came back.\n git@forge.example:a/b.git 303-555-0147\r\n"
    rows = [(1, text, "k"), (2, None, "k"), (3, "", "k"), (None, text, "k"), (4, "plain words only", "k"), (1, text, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = [tuple(x) for x in pii.find_pii(df, GIVEN).collect()]
    pieces = {("name", "Hugo Tolberg"), ("email", "hugo.tolberg@mail.example"), ("phone", "303-555-0147"), ("address", "12 Ruvogate Lane")}
    assert {x[1:] for x in got if x[0] == 1} == pieces == {x[1:] for x in got if x[0] is None}
    assert len(got) == 8
    out = {x.doc_id: x.text for x in pii.redact(df, GIVEN).collect()}
    assert out[2] is None and out[3] == "" and out[4] == "plain words only"
    assert out[1] == text.replace("Hugo Tolberg", "[NAME]").replace("hugo.tolberg@mail.example", "[EMAIL]").replace("303-555-0147", "[PHONE]").replace("12 Ruvogate Lane", "[ADDRESS]")
    assert pii.find_pii(df.limit(0), GIVEN).count() == 0


def test_no_candidate_is_cut_short():
    local, name = "very.long." * 12 + "name", "Maria Anna Sofia Clara Berta Ida Holmgren"
    text = f"From: {local}@mail.example\nby {name} in 123456 Ruvogate Lane\n" + "A" * 9 + " Bc" * 4000
    spans = {(k, text[a:b]) for k, a, b in pii.propose(text)}
    assert {("email", f"{local}@mail.example"), ("name", name), ("name", name[6:]), ("address", "123456 Ruvogate Lane")} <= spans
    assert len(pii.propose(text)) < 40_000
    assert any(k == "phone" and len(s) == 40 for k, s in {(k, ("1" * 40)[a:b]) for k, a, b in pii.propose("1" * 40)})


def test_long_text():
    text = ("word 12 " * 60_000) + " Reviewed-by: Selma Haskmond <selma@example.org>\n"
    assert {(k, text[a:b]) for k, a, b in pii.train(GIVEN).find([text])[0]} == {("name", "Selma Haskmond"), ("email", "selma@example.org")}
