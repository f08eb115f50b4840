"""Parent-child rows to full hierarchies, by peeling leaves.

Every round removes all leaves, each sending its subtree size to its parent, and
cuts about a third of the nodes out of chains that have shrunk to one child a node,
so that a chain of length n is gone in O(log n) rounds instead of n. What is never
peeled is on a cycle: chains are cut there too, until a cycle is one node pointing
at itself. Going back through the rounds, each removed node takes path, depth and
root (or the cycle) from the node it hung on, which was removed later.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from placeloom.runtime import Scratch

BLANKS = r"^[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+|[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+$"


def reference_key(c: Column) -> Column:
    """The form in which a reference is compared: no surrounding blanks, lower case."""
    return F.lower(F.regexp_replace(c, BLANKS, ""))


def parent_edges(rows: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(v, up)``: one row per id, ``up`` the id that its parent refers to or null.

    Rows without an id are no entries. Repeated rows of an id count once; when they disagree,
    the smallest parent that is an entry wins. Where several ids differ only by case or blanks,
    a parent means the one written alike, else the smallest.
    """
    raw = rows.select(F.col(id_col).cast("string").alias("v"), F.col(parent_col).cast("string").alias("_p"))
    raw = raw.filter(F.col("v").isNotNull())
    ids = raw.select("v").distinct().withColumn("_k", reference_key(F.col("v")))
    ids = ids.filter(F.col("_k") != "")
    by_key = ids.groupBy("_k").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
    refs = (
        raw.select("v", "_p", reference_key(F.col("_p")).alias("_k"))
        .filter(F.col("_k") != "")
        .distinct()
        .join(by_key, "_k", "inner")
    )
    alike = refs.filter(F.col("_n") > 1).join(ids.select(F.col("v").alias("_p"), F.lit(True).alias("_same")), "_p", "left")
    up = refs.filter(F.col("_n") == 1).select("v", F.col("_m").alias("up")).unionByName(
        alike.select("v", F.when(F.col("_same"), F.col("_p")).otherwise(F.col("_m")).alias("up"))
    )
    up = up.groupBy("v").agg(F.min("up").alias("up"))
    return raw.select("v").distinct().join(up, "v", "left")


def hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent", paths: bool = True) -> DataFrame:
    """One row per entry: ``entry_id, root, depth, path, n_descendants, below, cycle_id``.

    ``path`` is the array of ids from the root to the entry, ``depth`` 0 at a root. An entry whose
    chain of parents runs into a cycle has ``cycle_id``, the smallest id on that cycle, and null
    root, depth and path; ``n_descendants`` is null only on the cycle itself, and ``below`` is the way down to
    the entry, which may begin with ids of the cycle. Null, empty and unknown
    parents end a chain; an empty table gives no rows. ``paths=False`` gives ``entry_id, root, depth,
    cycle_id`` alone, at less cost.
    """
    scratch = Scratch(rows.sparkSession, "hierarchy")
    none = F.expr("cast(array() as array<string>)")
    edges = scratch.write(parent_edges(rows, id_col, parent_col))
    kids = edges.filter("up is not null").groupBy(F.col("up").alias("_u")).agg(F.count(F.lit(1)).alias("_kids"))
    # seg: nodes cut out between v and up, nearest first, n their number; ew: their sizes;
    # acc: v and the nodes peeled into it; low: smallest id in seg
    live = edges.join(kids, edges.v == kids._u, "left").select(
        "v", "up", F.coalesce("_kids", F.lit(0)).cast("long").alias("kids"), none.alias("seg"), F.lit(0).alias("n"),
        F.lit(None).cast("string").alias("low"), F.lit(0).cast("long").alias("ew"), F.lit(1).cast("long").alias("acc"),
        F.lit(0).alias("turn"),
    )
    live = scratch.write(live)
    rounds: list[tuple[DataFrame, DataFrame]] = []
    leaf = F.col("kids") == 0
    open_ = live.filter((F.col("up") != F.col("v")) | F.col("up").isNull()).limit(1).count()
    while open_:
        below = (
            live.filter("up is not null")
            .groupBy(F.col("up").alias("_b"))
            .agg(
                F.sum(F.when(leaf, F.col("acc") + F.col("ew")).otherwise(F.lit(0))).alias("_got"),
                F.sum(F.when(leaf, F.lit(0)).otherwise(F.lit(1))).cast("long").alias("_open"),
                F.max(F.when(~leaf, F.struct("v", "ew"))).alias("_one"),
            )
        )
        rank = lambda c: F.xxhash64(c, "turn")
        merged = live.join(below, live.v == below._b, "left").select(
            "v", "up", "seg", "n", "low", "ew", "turn", leaf.alias("leaf"),
            F.coalesce("_open", F.lit(0)).cast("long").alias("kids"),
            (F.col("acc") + F.coalesce("_got", F.lit(0))).alias("acc"),
            F.coalesce(
                ~leaf & F.col("up").isNotNull() & (F.col("_open") == 1) & (F.col("_one.v") != F.col("v")) & (F.col("up") != F.col("v"))
                & (rank("v") > rank("_one.v")) & (rank("v") > rank("up")),
                F.lit(False),
            ).alias("cutout"),
            F.col("_one.v").alias("child"), F.col("_one.ew").alias("child_ew"),
        )
        cut = merged.filter("cutout").select(*[F.col(c).alias("_" + c) for c in ("v", "up", "seg", "n", "low", "ew", "acc")])
        # whatever hung on a node cut out now hangs on that node's parent
        hung = F.col("_v").isNotNull()
        moved = merged.join(cut, merged.up == cut._v, "left").select(
            "v",
            F.when(hung, F.col("_up")).otherwise(F.col("up")).alias("up"),
            "kids",
            (F.when(hung, F.concat("seg", F.array("_v"), "_seg")).otherwise(F.col("seg")) if paths else F.col("seg")).alias("seg"),
            (F.col("n") + F.coalesce(F.col("_n") + 1, F.lit(0))).cast("int").alias("n"),
            F.least("low", "_v", "_low").alias("low"),
            (F.col("ew") + F.when(hung & ~F.col("leaf"), F.col("_ew") + F.col("_acc")).otherwise(F.lit(0))).alias("ew"),
            "acc", (F.col("turn") + 1).alias("turn"), "leaf", "cutout", "child", "child_ew",
        )
        # what is left to do is counted as the round is written, not by another job
        seen = Observation()
        todo = ~F.col("leaf") & ~F.col("cutout") & ((F.col("up") != F.col("v")) | F.col("up").isNull())
        moved = scratch.write(moved.observe(seen, F.count(F.when(todo, 1)).alias("n")))
        open_ = seen.get["n"]
        rounds.append((moved, moved.filter("leaf or cutout")))
        live = moved.filter("not leaf and not cutout").select("v", "up", "kids", "seg", "n", "low", "ew", "acc", "turn")
    size = [F.lit(None).cast("long").alias("size")] if paths else []
    path = [none.alias("path")] if paths else []
    parts = [
        live.select("v", F.col("v").alias("root"), F.lit(0).alias("depth"), F.least("v", "low").alias("cycle_id"), *path, *size)
    ]
    for written, late in reversed(rounds):
        known = reduce(DataFrame.unionByName, parts)
        head = known.select(F.col("v").alias("_v"), *[F.col(c).alias("_" + c) for c in known.columns if c not in ("v", "size")])
        now = late.join(head, late.up == head._v, "left")
        if paths:
            sizes = known.select(F.col("v").alias("_w"), F.col("size").alias("_size"))
            now = now.join(sizes, F.when(now.cutout, now.child) == sizes._w, "left")
            path = [F.when(F.col("up").isNull(), F.array("v")).otherwise(F.concat("_path", F.reverse("seg"), F.array("v"))).alias("path")]
            size = [F.when(F.col("leaf"), F.col("acc")).otherwise(F.col("acc") + F.col("child_ew") + F.col("_size")).alias("size")]
        now = now.select(
            "v",
            F.when(F.col("up").isNull(), F.col("v")).otherwise(F.col("_root")).alias("root"),
            F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.col("_depth") + F.col("n") + 1).cast("int").alias("depth"),
            F.col("_cycle_id").alias("cycle_id"), *path, *size,
        )
        parts.append(scratch.write(now))
        if written is not rounds[-1][0]:
            scratch.drop(written)  # its nodes are placed; the last round stays, as what is left of it is read with the result
    every = reduce(DataFrame.unionByName, parts)
    free = F.col("cycle_id").isNull()
    return every.select(
        F.col("v").alias("entry_id"),
        F.when(free, F.col("root")).alias("root"),
        F.when(free, F.col("depth")).alias("depth"),
        *([F.when(free, F.col("path")).alias("path"), (F.col("size") - 1).alias("n_descendants"), F.when(~free, F.col("path")).alias("below")] if paths else []),
        "cycle_id",
    )


def cycles(rows: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(entry_id, cycle_id)`` of the entries whose chain of parents runs into a cycle."""
    return hierarchy(rows, id_col, parent_col, paths=False).filter("cycle_id is not null").select("entry_id", "cycle_id")


def descendants(paths: DataFrame) -> DataFrame:
    """``(ancestor_id, entry_id, distance)`` from the result of :func:`hierarchy`, one row per pair.

    Entries below a cycle have the ancestors between the cycle and them; entries of a cycle are in no pair. So
    each entry is the ancestor of as many as ``n_descendants`` says. Lists stay rows: the root of a third of all
    entries never becomes one value. Only pairs below cycles are shuffled.
    """

    def pairs(way: str) -> DataFrame:
        up = paths.filter(f"{way} is not null").select("entry_id", F.size(way).alias("_n"), F.posexplode(way).alias("at", "ancestor_id"))
        return up.filter("at < _n - 1").select("ancestor_id", "entry_id", (F.col("_n") - 1 - F.col("at")).alias("distance"))

    ring = paths.filter("cycle_id is not null and n_descendants is null").select(F.col("entry_id").alias("_v"))
    under = pairs("below")
    for c in ("entry_id", "ancestor_id"):
        under = under.join(ring, F.col(c) == F.col("_v"), "left_anti")
    return pairs("path").unionByName(under)
