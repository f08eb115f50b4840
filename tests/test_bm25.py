"""BM25 against scoring every document."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from placeloom.operators import search


def test_bm25_against_scoring_every_document(spark):
    """q11: the best documents need not hold a query's rarest word."""
    r = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(common, k=3) + r.choices(rare, k=2))) for i in range(300)] + [(900, "unique"), (901, "c0 c0 c1")]
    asked = [(i, " ".join(r.sample(common, 2) + r.sample(rare, 2))) for i in range(30)] + [(50, "unique c0 c1 r3 r4"), (51, "c0"), (52, "c0 c1 c2"), (53, "none"), (54, "c1 c0 c2")]
    index = search.index_terms(spark.createDataFrame(docs, "id long, t string"), "id", F.col("t"))
    got = search.bm25_top(index, spark.createDataFrame(asked, "query_id long, q string"), "query_id", F.col("q")).collect()
    df = Counter(w for _, t in docs for w in set(t.split()))
    want = set()
    for q, text in asked:
        scores = []
        for d, t in docs:
            tf = Counter(t.split())
            hit = [w for w in set(text.split()) if w in tf]
            if hit:
                scores.append((-round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2) for w in hit), 6), d))
        want |= {(q, d, i + 1) for i, (_, d) in enumerate(sorted(scores)[:5])}
    assert {(x.query_id, x.doc, x.rank) for x in got} == want and len(got) == len(want)


def test_bm25_writes_only_the_best_of_each_word(spark, monkeypatch):
    """q11: common words together fetch many documents; pairs of a query and a document beyond the best are not written."""
    pairs, write = [], search.Scratch.write

    def seen(self, df):
        out = write(self, df)
        if {"w", "doc"} <= set(out.columns):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(search.Scratch, "write", seen)
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} c{i % 13}") for i in range(1001)], "id long, t string")
    asked = spark.createDataFrame([(7 * b + a, f"a{a} b{b}") for a in range(7) for b in range(11)], "query_id long, q string")
    got = search.bm25_top(search.index_terms(docs, "id", F.col("t")), asked, "query_id", F.col("q")).collect()
    want = {(7 * b + a, [i for i in range(1001) if i % 7 == a and i % 11 == b][r], r + 1) for a in range(7) for b in range(11) for r in range(5)}
    assert {(x.query_id, x.doc, x.rank) for x in got} == want and len(got) == len(want)
    assert sum(pairs) <= 77 * 2 * 5
