"""Joins, groupings and orders of the record build that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.operators.proximity import near_points
from placeloom.runtime import Scratch


def lowest_per_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group; first within pieces of a group, then among what is left of them.

    A group of a third of all rows is sorted in ``salts`` tasks, and at most ``salts * n`` of its rows meet.
    Null keys are a group of their own. Adds ``rank`` from 1.
    """
    piece = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    cut = df.withColumn("_piece", piece)
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order))).filter(F.col("rank") <= n)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n).drop("_piece")


def nearest(points: DataFrame, places: DataFrame, radius_m: float, point_id: str, place_id: str, k: int = 1) -> DataFrame:
    """``(point_id, place_id, distance_m, rank)``: the ``k`` nearest places within a radius; ties by id.

    Distances are rounded to millimetres before they are compared. Points without a place near give no row.
    """
    near = near_points(points, places, radius_m, point_id, place_id, with_distance=True).withColumn("distance_m", F.round("distance_m", 3))
    if k == 1:
        best = near.groupBy(point_id).agg(F.min(F.struct("distance_m", place_id)).alias("_b"))
        return best.select(point_id, F.col(f"_b.{place_id}").alias(place_id), "_b.distance_m", F.lit(1).alias("rank"))
    return lowest_per_group(near, [point_id], ["distance_m", place_id], k).select(point_id, place_id, "distance_m", "rank")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: smallest node of each component, of the nodes that have an edge.

    Each round every node takes the smallest label among its neighbours' and then the label of that label, so
    that rounds grow with the logarithm of the longest chain; labels are written in the shared folder
    between rounds. Null ends and loops join nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = scratch.write(ends.union(ends.select("y", "x")).distinct())
    labels = scratch.write(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        from_near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("m"))
        hooked = labels.join(from_near, labels.node == from_near.x, "left").select("node", "component", F.least("component", "m").alias("new"))
        up = labels.select(F.col("node").alias("p"), F.col("component").alias("q"))
        jumped = hooked.join(up, hooked.new == up.p, "left").select("node", F.least("new", "q").alias("component"), (F.least("new", "q") < F.col("component")).alias("moved"))
        state = scratch.write(jumped)
        moving = state.filter("moved").limit(1).count()
        scratch.drop(labels)
        labels = state.drop("moved")
        if not moving:
            return labels


def close_pairs(keyed: DataFrame, keys: list[str], place_id: str, radius_m: float) -> DataFrame:
    """``(a, b)`` of rows that share ``keys`` and lie within a radius of one another, ``a < b``.

    A spatial self-join: rows meet by cell of the grid, the keys are compared after, so that a key in a
    third of all rows doesn't pair all of them.
    """
    ids = keyed.select(F.col(place_id).alias("_i"), "lon", "lat")
    near = near_points(ids.withColumnRenamed("_i", "a"), ids.withColumnRenamed("_i", "b"), radius_m, "a", "b").filter("a < b")
    left = keyed.select(F.col(place_id).alias("a"), *[F.col(k).alias(f"{k}_a") for k in keys])
    right = keyed.select(F.col(place_id).alias("b"), *[F.col(k).alias(f"{k}_b") for k in keys])
    same = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys]
    met = near.join(left, "a").join(right, "b")
    for s in same:
        met = met.filter(s)
    return met.select("a", "b").distinct()
