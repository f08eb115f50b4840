"""Map elements (nodes, ways, relations with tags) to candidates of records: what they are, what is wrong with them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text
from placeloom.operators.relational import close_pairs, connected_components
from placeloom.runtime import Scratch

# Kinds of highway that are no street; tag keys that state a locality, areas below it, and a region.
NOT_STREETS = ["abandoned", "bus_stop", "corridor", "platform", "proposed", "rest_area", "services"]
LOCALITY_KEYS = ["addr:city", "addr:town", "addr:village", "addr:hamlet"]
AREA_KEYS = ["addr:suburb", "addr:quarter", "addr:neighbourhood"]
BLOCK_AREA_KEYS = ["addr:quarter", "addr:neighbourhood"]
REGION_KEYS = ["addr:state", "addr:province"]
RELEVANT_KEYS = ["place", "highway", "boundary", "shop", "amenity", "tourism", "office"]


def tag(tags: Column, key: str) -> Column:
    """A tag's value with single blanks; null where it says nothing."""
    return text.collapse_whitespace(F.element_at(tags, key))


def first_tag(tags: Column, keys: list[str]) -> Column:
    return F.coalesce(*[tag(tags, k) for k in keys])


def may_matter(tags: Column) -> Column:
    """whether any tag can make an element a record."""
    return F.exists(F.map_keys(tags), lambda k: k.startswith("addr:") | k.isin(RELEVANT_KEYS))


def is_street(tags: Column) -> Column:
    """F4."""
    highway = F.element_at(tags, "highway")
    return F.coalesce(~highway.isin(NOT_STREETS), F.lit(False))


def address_components(tags: Column) -> Column:
    """``struct(issue, number, street, place, unit, locality, areas, region, postcode, country)``.

    An address has a house or a block number, and a street, a place, or stands in the block scheme (a block number, or a quarter
    or neighbourhood). Block and house are joined as ``block-house``. ``areas`` are distinct, outermost first.
    """
    house, block, street, place = (tag(tags, f"addr:{k}") for k in ("housenumber", "block_number", "street", "place"))
    number = F.nullif(F.concat_ws("-", block, house), F.lit(""))
    scheme = block.isNotNull() | first_tag(tags, BLOCK_AREA_KEYS).isNotNull()
    issue = F.when(number.isNull(), "missing_house_number").when(street.isNull() & place.isNull() & ~scheme, "missing_street_or_place")
    areas = F.array_distinct(F.array_compact(F.array(*[tag(tags, k) for k in AREA_KEYS])))
    return F.struct(
        issue.alias("issue"), number.alias("number"), street.alias("street"), place.alias("place"), tag(tags, "addr:unit").alias("unit"), first_tag(tags, LOCALITY_KEYS).alias("locality"),
        areas.alias("areas"), first_tag(tags, REGION_KEYS).alias("region"), tag(tags, "addr:postcode").alias("postcode"), tag(tags, "addr:country").alias("country"),
    )


def match_presets(elements: DataFrame, presets: DataFrame) -> DataFrame:
    """``(id, preset)`` of elements with a preset all of whose tags they have ('*': any value).

    The one with most stated values wins, then with most tags, then the higher score, then the lower name. ``elements(id, tags)``,
    ``presets(preset, tags, score)``: tags meet on their key, so that no element is compared with every preset.
    """
    wanted = presets.select("preset", "score", F.size("tags").alias("of"), F.explode("tags").alias("key", "value"))
    have = elements.select("id", F.explode("tags").alias("key", "own"))
    met = have.join(wanted, "key").filter("value = '*' or value = own").groupBy("id", "preset", "score", "of").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") != "*", 1).otherwise(0)).alias("stated"))
    best = met.filter("n = of").groupBy("id").agg(F.min(F.struct((-F.col("stated")).alias("a"), (-F.col("of")).alias("b"), (-F.col("score")).alias("c"), "preset")).alias("m"))
    return best.select("id", F.col("m.preset").alias("preset"))


def prominence(tags: Column) -> Column:
    """``struct(linked, languages)``: a link to an item or article, and the distinct languages of its names."""
    named = F.filter(F.map_keys(tags), lambda k: k.rlike("^name:[a-z]{2,3}([-_][A-Za-z0-9]+)*$"))
    languages = F.array_distinct(F.transform(named, lambda k: F.regexp_extract(k, "^name:([a-z]{2,3})", 1)))
    linked = F.exists(F.map_keys(tags), lambda k: k.isin("wikidata", "wikipedia"))
    return F.struct(linked.alias("linked"), F.size(languages).alias("languages"))


def stitch_rings(members: DataFrame, relation: str = "relation") -> DataFrame:
    """``(relation, role, ring, closed, points, area)``, the rings that member ways form end to end.

    ``members(relation, role, way, refs, lons, lats)``. Ways are joined at equal end nodes in either direction, from the lowest way id
    on; what doesn't close is given with ``closed`` false. ``area`` is the plane one in square degrees. A relation's ways
    come together in one task: its ring is one value anyway.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for role, rows in frame.groupby("role"):
            left = {r.way: list(zip(r.refs, r.lons, r.lats)) for r in rows.sort_values("way").itertuples() if len(r.refs) > 1}
            number = 0
            while left:
                line = left.pop(min(left))
                grown = True
                while grown and line[0][0] != line[-1][0]:
                    grown = False
                    for w in sorted(left):
                        part = left[w]
                        for way in (part, part[::-1]):
                            if way[0][0] == line[-1][0]:
                                line, grown = line + way[1:], True
                                del left[w]
                                break
                        if grown:
                            break
                number += 1
                area = abs(sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(line, line[1:] + line[:1]))) / 2
                closed = line[0][0] == line[-1][0] and len(line) > 3
                out.append((frame[relation].iloc[0], role, number, closed, len(line), area if closed else None))
        return pd.DataFrame(out, columns=[relation, "role", "ring", "closed", "points", "area"])

    kind = members.schema[relation].dataType.simpleString()
    return members.groupBy(relation).applyInPandas(run, f"{relation} {kind}, role string, ring int, closed boolean, points int, area double")


def greedy_leaders(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """``(node, leader)``: in the order of ``nodes(node, place)``, a node follows the first leader near it or else leads.

    ``near(a, b)`` are pairs of nodes, each pair once in either direction. What a walk through all nodes in turn would give, but in rounds:
    a node is settled as soon as all earlier nodes near it are; settled ones leave. Rounds are as many as the longest
    chain of undecided neighbours. ``place`` must differ from node to node.
    """
    scratch = Scratch(nodes.sparkSession, "leaders")
    order = nodes.select("node", "place")
    ends = near.select("a", "b").union(near.select("b", "a")).distinct()
    earlier = ends.join(order.select(F.col("node").alias("a"), F.col("place").alias("pa")), "a").join(order.select(F.col("node").alias("b"), F.col("place").alias("pb")), "b")
    edges = scratch.write(earlier.filter("pa < pb").select("a", "b", "pa"))  # b may follow a
    alone = order.join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
    done = scratch.write(alone.select("node", F.col("node").alias("leader")))
    parts, open_edges = [done], edges
    while open_edges.limit(1).count():
        leads = done.select(F.col("node").alias("a"), (F.col("node") == F.col("leader")).alias("leads"))
        state = open_edges.join(leads, "a", "left")
        first = F.min(F.when(F.col("leads"), F.struct("pa", "a")))
        pending = F.min(F.when(F.col("leads").isNull(), F.col("pa")))
        judged = state.groupBy("b").agg(first.alias("f"), pending.alias("p"))
        # the first leader counts once nothing before it is open; without one, all must have followed others
        ready = judged.filter(F.col("p").isNull() | (F.col("f.pa") < F.col("p")))
        now = scratch.write(ready.select(F.col("b").alias("node"), F.coalesce("f.a", "b").alias("leader")))
        parts.append(now)
        gone = now.select(F.col("node").alias("b"))
        # an edge from a follower says nothing more; edges from nodes settled before stay until their end is settled
        open_edges = scratch.write(open_edges.join(gone, "b", "left_anti"))
        done = scratch.write(done.unionByName(now))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_ways(ways: DataFrame, vertices: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """``(street, name, ways, way_ids, road_class)``: ways of one name within a radius of each other are one street.

    ``ways(way, name, road_class)``, ``vertices(way, seq, name, lon, lat)``. The lowest way id names the street; ``way_ids`` are sorted.
    """
    points = vertices.select(F.struct("way", "seq").alias("id"), "name", "lon", "lat")
    met = close_pairs(points, ["name"], "id", radius_m).select(F.col("a.way").alias("a"), F.col("b.way").alias("b")).filter("a <> b").distinct()
    groups = connected_components(met)
    of = ways.join(groups, ways.way == groups.node, "left").select("way", "name", "road_class", F.coalesce("component", "way").alias("street"))
    return of.groupBy("street").agg(F.min_by("name", "way").alias("name"), F.count(F.lit(1)).alias("ways"), F.array_join(F.array_sort(F.collect_set("way")), "|").alias("way_ids"), F.min("road_class").alias("road_class"))


def interpolation_issue(rule: Column, start: Column, stop: Column, street_a: Column, street_b: Column) -> Column:
    """Why two anchors of an interpolation way give no range, else null. Rules: odd, even, all, or a step."""
    step = F.when(rule.isin("odd", "even"), 2).when(rule == "all", 1).otherwise(F.expr("try_cast(null as int)"))
    stated = F.when(rule.rlike("^[1-9][0-9]{0,3}$"), rule.cast("int"))
    size = F.coalesce(step, stated)
    parity = F.when(rule == "odd", 1).when(rule == "even", 0)
    return (
        F.when(size.isNull(), "unsupported_value").when(street_a != street_b, "street_conflict").when(start == stop, "equal_anchors")
        .when(parity.isNotNull() & ((start % 2 != parity) | (stop % 2 != parity)), "wrong_parity").when((stop - start) % size != 0, "not_divisible")
    )
