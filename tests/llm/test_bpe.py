"""Ids against a public implementation of the same vocabulary."""

import os
import random

import pytest

from placeloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids(spark):
    r = random.Random(2)
    signs = [chr(c) for c in range(256)] + list("́​　一\U0001f600﻿ ") + list(" \n\t'sdlt") * 30
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["", "a" * 4000, " " * 900 + "x", "<|endoftext|> it's", "same", "same", "x" + "the" * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 1), (None, "ab", 1)], "doc_id long, text string, ids int")
    got = bpe.token_ids(df).collect()
    by = {x.doc_id: x.ids for x in got}
    assert len(got) == len(texts) + 2 and by[-1] == []
    assert [by[i] for i in range(len(texts))] == reference(texts)
    counts = {x.doc_id: x.n_tokens for x in bpe.token_counts(df, keep=["doc_id"]).collect()}
    assert all(counts[i] == len(by[i]) for i in by)


def test_empty(spark):
    assert bpe.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0
