"""Hierarchies against walking every chain."""

import random

from placeloom.operators import hierarchy

SCHEMA = "id string, parent string, root string, depth int"


def brute(rows):
    parents = {}
    for i, p in rows:
        if i is not None:
            parents.setdefault(i, None)
            if p is not None and p.strip().lower() in {x.lower() for x, _ in rows if x}:
                parents[i] = next(x for x in sorted(x for x, _ in rows if x) if x.lower() == p.strip().lower())
    out = {}
    for i in parents:
        chain = [i]
        while parents[chain[-1]] is not None and parents[chain[-1]] not in chain:
            chain.append(parents[chain[-1]])
        up = parents[chain[-1]]
        out[i] = (None, min(chain[chain.index(up) :])) if up is not None else (chain[::-1], None)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in rows], SCHEMA)
    got = hierarchy.hierarchy(df).collect()
    want = brute(rows)
    assert {r.entry_id: (r.path, r.cycle_id) for r in got} == want
    assert len(got) == len(want)
    for r in got:
        if r.path is not None:
            assert r.depth == len(r.path) - 1 and r.root == r.path[0]
            assert r.n_descendants == sum(1 for p, _ in want.values() if p and r.entry_id in p[:-1])


def test_chain_star_cycle_and_dirt(spark):
    rows = [("r", None)] + [(f"c{i}", f"c{i - 1}" if i else " R ") for i in range(12)] + [(f"s{i}", "C3") for i in range(9)]
    rows += [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("below", "l2"), ("deep", "below"), ("self", "SELF"), ("lost", "nowhere"), ("blank", "  ")]
    rows += [(None, "r"), ("c5", "c4"), ("c5", "c4")]
    check(spark, rows)


def test_random_forest(spark):
    r = random.Random(3)
    ids = [f"n{i}" for i in range(40)]
    check(spark, [(i, r.choice(ids + ["?"])) for i in ids])


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchy(empty).count() == 0


def test_cycles_alone(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None)], "id string, parent string")
    assert {tuple(r) for r in hierarchy.cycles(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    rows = hierarchy.descendants(hierarchy.hierarchy(df)).collect()
    assert sorted((r.ancestor_id, r.entry_id, r.distance) for r in rows) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
