"""Descendants below cycles."""

import random
from collections import Counter

from placeloom.operators import hierarchy


def test_descendants_below_cycles(spark):
    """p3_descendants: as many rows of an ancestor as n_descendants says, below cycles too."""
    r = random.Random(8)
    rows = [(f"n{i}", f"n{r.randrange(60)}") for i in range(60)] + [(f"d{i}", f"d{i - 1}" if i else "n0") for i in range(9)] + [("free", None), ("kid", "free")]
    paths = hierarchy.hierarchy(spark.createDataFrame(rows, "id string, parent string"))
    want = {x.entry_id: x.n_descendants for x in paths.collect() if x.n_descendants}
    pairs = {tuple(x) for x in hierarchy.descendants(paths).collect()}
    assert Counter(a for a, _, _ in pairs) == want
    up = dict(rows)
    for a, b, n in pairs:
        for _ in range(n):
            b = up[b]
        assert a == b
