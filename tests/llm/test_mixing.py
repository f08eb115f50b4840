"""Shares, limits of repetition and overlap of mixtures."""

import os

import pytest
from pyspark.sql import functions as F

from placeloom.llm import bpe, mixing


def test_plan_is_largest_and_on_target():
    sums = {("a",): 100, ("a", "b"): 50, ("b",): 10, ("c",): 500}
    plan = mixing.plan_mix(sums, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 1, "b": 2, "c": 1})
    got = {s: sum(n for (_, t), n in plan.items() if t == s) for s in "abc"}
    # a and b share 100 once, 50 at most twice in all, and 10 twice: 220 tokens for 0.8 of the mixture
    assert sum(got.values()) in (273, 274, 275) and abs(got["a"] - got["b"]) <= 1
    assert mixing.plan_mix({}, {"a": 1.0}, {"a": 1}) == {}
    assert mixing.plan_mix({("a",): 5}, {"a": 0.5, "empty": 0.5}, {"a": 1, "empty": 1}) == {(("a",), "a"): 5}


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
def test_mixture(spark):
    rows = [(i, f"word {i} of the text number {i * 7}", s, 1) for s, at, n in (("big", 0, 400), ("small", 1000, 40)) for i in range(at, at + n)]
    rows += [(5000, None, "big", 1), (5001, "", "small", 1), (5002, "x", None, 1), (5003, "stranger", "other", 1), (5004, rows[0][1], "small", 1), (5005, rows[1][1], "big", 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, uses int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("void", None, 1)], "source string, weight double, max_repeats int")
    mixture = mixing.mix_sources(documents, targets)
    out = mixture.collect()
    assert len({(x.doc_id, x.source) for x in out}) == len(out)
    assert all(x.uses <= {"big": 1, "small": 3}[x.source] for x in out)
    assert not {x.doc_id for x in out} & {5000, 5001, 5002, 5003}  # 5005 copies a text of its source and is a document of its own
    share = {x.source: x.share for x in mixing.shares(mixture, targets).collect()}
    assert abs(share["big"] - 0.7) < 0.02 and abs(share["small"] - 0.3) < 0.02 and share["void"] == 0
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix_sources(documents.orderBy(F.rand(1)), targets).collect()))
    assert mixing.mix_sources(documents.limit(0), targets).count() == 0


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
def test_copies_within_a_source_are_documents(spark):
    rows = [(i, "the same words again", "only") for i in range(5)] + [(9, "the same words again", "other"), (3, "the same words again", "only")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("only", 1.0, 2)], "source string, weight double, max_repeats int")
    assert {(x.doc_id, x.uses) for x in mixing.mix_sources(documents, targets).collect()} == {(i, 2) for i in range(5)}
