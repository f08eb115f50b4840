"""Queries of raw map elements, drawn from the tables: families F, B and the parts of T, G, J, A that work on elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import elements, proximity, relational
from placeloom.plans import build_queries as build
from placeloom.plans.build_queries import _BOX, _INBOX, _K, _KI, _LOC, _PINGS, _WK, DIST, keyed, keyed_imports
from placeloom.plans.catalogue import query
from placeloom.plans.scalar_queries import ADR, HAV, OK_, addresses, key
from placeloom.runtime import table

# Elements: every address is a node whose tags come from its columns and number.
_TAGS = {
    "addr:housenumber": "housenumber", "addr:street": "case when rec_id % 4 <> 3 then street end", "addr:place": "case when rec_id % 8 = 3 then locality end",
    "addr:block_number": "case when rec_id % 16 = 7 then cast(rec_id % 30 as string) end", "addr:quarter": "case when rec_id % 32 = 7 then locality end", "addr:city": "case when rec_id % 3 <> 0 then locality end",
    "addr:town": "case when rec_id % 3 = 0 then locality end", "addr:state": "case when rec_id % 2 = 0 then region end", "addr:province": "case when rec_id % 2 = 1 then region end", "addr:postcode": "postcode",
    "name": "name", "shop": "case rec_id % 7 when 0 then 'bakery' when 1 then 'books' end", "amenity": "case rec_id % 7 when 2 then 'pharmacy' when 3 then 'library' end", "brand": "case when rec_id % 14 = 0 then 'Breadly' end",
    "wikidata": "case when rec_id % 9 = 0 then concat('Q', cast(rec_id as string)) end", "name:en": "case when rec_id % 5 = 0 then name end", "name:en-GB": "case when rec_id % 10 = 0 then name end", "name:fr": "case when rec_id % 15 = 0 then name end",
    "place": "case when rec_id % 50 = 1 then 'village' end", "highway": "case rec_id % 6 when 0 then 'residential' when 1 then 'corridor' when 2 then 'primary_link' end", "note": "case when rec_id % 11 = 0 then 'x' end",
}
_NODE_COLUMNS = ["housenumber", "street", "locality", "region", "postcode", "name", "lon", "lat"]
_T = {k: v.replace(" as string)", " as varchar)") for k, v in _TAGS.items()}
_C = lambda k: f"nullif(trim(regexp_replace({_T[k]}, '\\s+', ' ', 'g')), '')"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """``id, lon, lat, tags`` of map nodes."""
    rows = addresses(spark, sf, *_NODE_COLUMNS)
    tags = F.map_filter(F.create_map(*[x for k, v in _TAGS.items() for x in (F.lit(k), F.expr(v))]), lambda k, v: v.isNotNull())
    return rows.select(F.col("rec_id").alias("id"), "lon", "lat", tags.alias("tags"))


_ANY = lambda *keys: "(" + " or ".join(f"({_T[k]}) is not null" for k in keys) + ")"
_ADDRS = [k for k in _TAGS if k.startswith("addr:")]


@query("f1_relevant_elements", f"select rec_id as id, {_ANY(*_ADDRS, 'place', 'highway', 'shop', 'amenity')} as relevant from {ADR}")
def f1(spark, sf):
    return nodes(spark, sf).select("id", elements.may_matter(F.col("tags")).alias("relevant"))


@query("f4_streets", f"select rec_id as id, {_T['highway']} as highway, {_T['highway']} <> 'corridor' as street from {ADR} where {_T['highway']} is not null")
def f4(spark, sf):
    highway = F.element_at("tags", "highway")
    return nodes(spark, sf).filter(highway.isNotNull()).select("id", highway.alias("highway"), elements.is_street(F.col("tags")).alias("street"))


_NUM5 = f"nullif(concat_ws('-', {_C('addr:block_number')}, {_C('addr:housenumber')}), '')"
_ISSUE = f"case when {_NUM5} is null then 'missing_house_number' when {_C('addr:street')} is null and {_C('addr:place')} is null and {_C('addr:block_number')} is null and {_C('addr:quarter')} is null then 'missing_street_or_place' end"


@query("f3_b5_address_components", f"select rec_id as id, {_ISSUE} as issue, {_NUM5} as number, {_C('addr:street')} as street, {_C('addr:place')} as place, coalesce({_C('addr:city')}, {_C('addr:town')}) as locality, {_C('addr:quarter')} as areas, coalesce({_C('addr:state')}, {_C('addr:province')}) as region, {_C('addr:postcode')} as postcode from {ADR}")
def f3(spark, sf):
    c = nodes(spark, sf).select("id", elements.address_components(F.col("tags")).alias("c"))
    return c.select("id", *[F.col(f"c.{k}").alias(k) for k in ("issue", "number", "street", "place", "locality", "region", "postcode")], F.nullif(F.array_join("c.areas", "|"), F.lit("")).alias("areas"))


# Fixed values of the queries: presets, each with its tags and score.
_PRESETS = [
    ("shop", {"shop": "*"}, 0.5), ("shop/bakery", {"shop": "bakery"}, 1.0), ("shop/bakery/breadly", {"shop": "bakery", "brand": "Breadly"}, 1.0), ("amenity", {"amenity": "*"}, 0.4),
    ("amenity/pharmacy", {"amenity": "pharmacy"}, 1.0), ("amenity/pharmacy-2", {"amenity": "pharmacy"}, 0.9), ("place/village", {"place": "village"}, 1.0),
]
_PRESET = f"case when {_T['brand']} = 'Breadly' and {_T['shop']} = 'bakery' then 'shop/bakery/breadly' when {_T['shop']} = 'bakery' and {_T['place']} is null then 'shop/bakery' when {_T['amenity']} = 'pharmacy' then 'amenity/pharmacy' when {_T['place']} = 'village' and coalesce({_T['shop']}, '') <> 'bakery' then 'place/village' when {_T['shop']} = 'bakery' then 'place/village' when {_T['shop']} is not null then 'shop' when {_T['amenity']} is not null then 'amenity' end"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PRESETS, "preset string, tags map<string,string>, score double")


@query("f6_presets", f"select id, preset from (select rec_id as id, {_PRESET} as preset from {ADR}) where preset is not null")
def f6(spark, sf):
    return elements.match_presets(nodes(spark, sf).select("id", "tags"), presets(spark))


@query("f5_places_of_interest", f"select id, preset, name from (select rec_id as id, {_PRESET} as preset, case when regexp_matches({_C('name')}, '\\p{{L}}') then {_C('name')} else {_C('brand')} end as name from {ADR}) where preset is not null and name is not null")
def f5(spark, sf):
    n = nodes(spark, sf)
    own = elements.tag(F.col("tags"), "name")
    named = n.select("id", F.when(own.rlike(r"\p{L}"), own).otherwise(elements.tag(F.col("tags"), "brand")).alias("name")).filter("name is not null")
    return elements.match_presets(n.select("id", "tags"), presets(spark)).join(named, "id")


@query("f2_element_classes", f"""select id, class from (select rec_id as id, unnest([case when {_ISSUE} is null then 'address' end, case when {_PRESET} is not null and coalesce(case when regexp_matches({_C('name')}, '\\p{{L}}') then {_C('name')} end, {_C('brand')}) is not null then 'poi' end,
 case when {_T['place']} is not null and {_C('name')} is not null then 'place' end, case when {_T['highway']} <> 'corridor' then 'street' end]) as class from {ADR}) where class is not null""")
def f2(spark, sf):
    n, tags = nodes(spark, sf), F.col("tags")
    own = F.array_compact(F.array(
        F.when(elements.address_components(tags)["issue"].isNull(), "address"),
        F.when(text.place_tier(F.element_at(tags, "place")).isNotNull() & elements.tag(tags, "name").isNotNull(), "place"), F.when(elements.is_street(tags), "street"),
    ))
    return n.select("id", F.explode(own).alias("class")).unionByName(f5(spark, sf).select("id", F.lit("poi").alias("class")))


@query("t17_prominence", f"select rec_id as id, {_T['wikidata']} is not null as linked, cast(case when {_T['name:en']} is not null or {_T['name:en-GB']} is not null then 1 else 0 end + case when {_T['name:fr']} is not null then 1 else 0 end as integer) as languages from {ADR}")
def t17(spark, sf):
    return nodes(spark, sf).select("id", elements.prominence(F.col("tags")).alias("p")).select("id", "p.linked", "p.languages")


@query("b4_poi_addresses", f"select id || ':poi' as record, 'poi' as layer from (select cast(rec_id as varchar) as id, {_PRESET} as preset, coalesce(case when regexp_matches({_C('name')}, '\\p{{L}}') then {_C('name')} end, {_C('brand')}) as name from {ADR}) where preset is not null and name is not null union all select cast(rec_id as varchar) || ':address', 'address' from {ADR} where {_ISSUE} is null")
def b4(spark, sf):
    """A place of interest with an address emits both records."""
    c = f2(spark, sf).filter("class in ('poi', 'address')")
    return c.select(F.concat_ws(":", "id", "class").alias("record"), F.col("class").alias("layer"))


# ---- ways: the addresses of a street in order, four to a way

_WAYS = f"(select *, (row_number() over w - 1) // 4 as part, row_number() over w as seq from {_WK} window w as (partition by locality, s order by b, rec_id))"
_WAY = f"(select *, min(rec_id) over (partition by locality, s, part) as way from {_WAYS})"


def ways(spark: SparkSession, sf: str) -> DataFrame:
    """``way, seq, name, rec_id, b, lon, lat``: vertices of ways."""
    w = build.Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    k = build.numbered(spark, sf).withColumn("seq", F.row_number().over(w)).withColumn("part", F.floor((F.col("seq") - 1) / 4))
    first = F.min("rec_id").over(build.Window.partitionBy("locality", "s", "part"))
    return k.select(first.alias("way"), "seq", F.col("s").alias("name"), "rec_id", "b", "lon", "lat")


@query("j19_joined_ways", f"""with recursive v as (select way, seq, s, lon, lat from {_WAY}), e as (select distinct a.way as x, b.way as y from v a join v b on a.s = b.s and a.way <> b.way and abs(a.lat - b.lat) < 0.001 and {DIST} <= 50),
 r(node, other) as (select way, way from (select distinct way from v) union select r.node, e.y from r join e on e.x = r.other), g as (select node, min(other) as street from r group by node)
 select street, arg_min(s, way) as name, count(*) as ways, string_agg(cast(way as varchar), '|' order by way) as way_ids, cast(min(way % 5) as integer) as road_class from (select distinct way, s from v) w join g on g.node = w.way group by street""")
def j19(spark, sf):
    v = ways(spark, sf)
    one = v.groupBy("way").agg(F.first("name").alias("name")).withColumn("road_class", (F.col("way") % 5).cast("int"))
    return elements.join_ways(one, v.select("way", "seq", "name", "lon", "lat"))


@query("g4_along_lines", f"""with v as (select *, coalesce({HAV.format(a='lag(lon) over w', b='lag(lat) over w', c='lon', d='lat')}, 0) as d from {_WAY} window w as (partition by way order by seq)), c as (select *, sum(d) over (partition by way order by seq) as along, sum(d) over (partition by way) as total from v)
 select way, rec_id, round(case when total > 0 then along / total end, 6) as fraction from c""")
def g4(spark, sf):
    w = build.Window.partitionBy("way").orderBy("seq")
    d = ways(spark, sf).withColumn("d", F.coalesce(geo.distance_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0)))
    whole = build.Window.partitionBy("way")
    c = d.withColumn("along", F.sum("d").over(w)).withColumn("total", F.sum("d").over(whole))
    return c.select("way", "rec_id", F.round(F.when(F.col("total") > 0, F.col("along") / F.col("total")), 6).alias("fraction"))


@query("g19_road_middles", f"""with v as (select way, lon, lat, max(lon) over x - min(lon) over x >= max(lat) over x - min(lat) over x as wide from {_WAY} window x as (partition by way)),
 o as (select way, lon, lat, row_number() over (partition by way order by case when wide then lon else lat end, case when wide then lat else lon end) as r, count(*) over (partition by way) as n from v) select way, lon, lat from o where r = n // 2 + 1""")
def g19(spark, sf):
    """The vertex in the middle along the longer side of a way's box."""
    g = ways(spark, sf).groupBy("way").agg(F.collect_list(F.struct("lon", "lat")).alias("p"), (F.max("lon") - F.min("lon") >= F.max("lat") - F.min("lat")).alias("wide"))
    across = F.array_sort("p")
    upward = F.array_sort(F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))))
    at = (F.floor(F.size("p") / 2)).cast("int")
    a, b = F.get(across, at), F.get(upward, at)
    return g.select("way", F.when(F.col("wide"), a["lon"]).otherwise(b["lon"]).alias("lon"), F.when(F.col("wide"), a["lat"]).otherwise(b["lat"]).alias("lat"))


_RULE = "case rec_id % 5 when 0 then 'odd' when 1 then 'even' when 2 then 'all' when 3 then '3' else 'alphabetic' end"
_ENDS = f"(select rec_id, next_id, b, next_b, {_RULE} as rule from (select rec_id, b, lead(rec_id) over w as next_id, lead(b) over w as next_b from {_WAY} window w as (partition by way order by seq)) where next_b is not null)"


@query("b6_interpolations", f"""select rec_id, next_id, case when rule = 'alphabetic' then 'unsupported_value' when b = next_b then 'equal_anchors' when rule = 'odd' and (b % 2 = 0 or next_b % 2 = 0) then 'wrong_parity' when rule = 'even' and (b % 2 = 1 or next_b % 2 = 1) then 'wrong_parity'
 when rule = '3' and (next_b - b) % 3 <> 0 then 'not_divisible' end as issue from {_ENDS}""")
def b6(spark, sf):
    w = build.Window.partitionBy("way").orderBy("seq")
    v = ways(spark, sf)
    e = v.select("rec_id", F.lead("rec_id").over(w).alias("next_id"), "b", F.lead("b").over(w).alias("next_b"), F.expr(_RULE).alias("rule"), "name").filter("next_b is not null")
    return e.select("rec_id", "next_id", elements.interpolation_issue(F.col("rule"), F.col("b"), F.col("next_b"), F.col("name"), F.col("name")).alias("issue"))


@query("b7_street_issues", f"select way, case when way % 7 = 0 and way % 2 = 0 then 'ref_only_name' when way % 7 = 0 then 'missing_name' when n < 2 then 'too_few_points' end as issue from (select way, count(*) as n from {_WAY} group by way)")
def b7(spark, sf):
    """Why a way is no street: it has no name (but a ref, or nothing), or fewer than two points."""
    n = ways(spark, sf).groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.first("name").alias("own"))
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(F.col("way") % 7 != 0, F.col("own")), F.lit("ref"), F.when(F.col("way") % 2 == 0, F.lit("R1"))), lambda k, v: v.isNotNull())
    name, ref = elements.tag(tags, "name"), elements.tag(tags, "ref")
    return n.select("way", F.when(name.isNull() & ref.isNotNull(), "ref_only_name").when(name.isNull(), "missing_name").when(F.col("n") < 2, "too_few_points").alias("issue"))


@query("j2_node_coordinates", f"select way, seq, lon, lat from {_WAY}")
def j2_nodes(spark, sf):
    """Only nodes that ways refer to are kept, and each reference gets its coordinates."""
    refs = ways(spark, sf).select("way", "seq", F.col("rec_id").alias("id"))
    kept = addresses(spark, sf, "lon", "lat").select(F.col("rec_id").alias("id"), "lon", "lat").join(refs.select("id").distinct(), "id", "left_semi")
    return refs.join(kept, "id").select("way", F.col("seq").cast("long").alias("seq"), "lon", "lat")


# ---- relations: every locality's box in four ways, one of them missing where its name is of even length

_AREA_SQL = f"select locality as relation, 'outer' as role, cast(1 as integer) as ring, length(locality) % 2 = 1 as closed, cast(case when length(locality) % 2 = 1 then 5 else 4 end as integer) as points, case when length(locality) % 2 = 1 then round((e - w) * (n - s), 9) end as area from {_BOX}"


@query("j3_g13_rings", _AREA_SQL)
def j3(spark, sf):
    """Member ways, in any order and direction, meet their lines and are stitched to rings."""
    b = build.boxes(spark, sf)
    corner = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.col(x).alias("lon"), F.col(y).alias("lat")) for i, (x, y) in enumerate((("w", "s"), ("e", "s"), ("e", "n"), ("w", "n"), ("w", "s")))])
    sides = b.withColumn("c", corner).select("locality", "c", F.explode(F.array(*map(F.lit, (2, 0, 3, 1)))).alias("i")).filter("i <> 3 or length(locality) % 2 = 1")
    side = F.array(F.get("c", F.col("i")), F.get("c", F.col("i") + 1))
    turned = F.when(F.col("i") % 2 == 1, F.reverse(side)).otherwise(side)
    lines = sides.select(F.concat_ws(":", "locality", "i").alias("way"), turned.alias("line"))
    members = sides.select(F.col("locality").alias("relation"), F.lit("outer").alias("role"), F.concat_ws(":", "locality", "i").alias("way"), "i")
    node = lambda n: F.transform("line", lambda x: x[n] % 4 if n == "id" else x[n])
    met = members.join(lines, "way").select("relation", "role", "way", node("id").alias("refs"), node("lon").alias("lons"), node("lat").alias("lats"))
    return elements.stitch_rings(met).withColumn("area", F.round("area", 9))


_CBOX = f"(select country, min(lon) - 0.001 as w, max(lon) + 0.001 as e, min(lat) - 0.001 as s, max(lat) + 0.001 as n from (select distinct rec_id, country, lon, lat from osm_addresses where {OK_} and country is not null) group by country)"


def country_boxes(spark: SparkSession, sf: str) -> DataFrame:
    a = addresses(spark, sf, "country", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("country").isNotNull())
    return a.groupBy("country").agg((F.min("lon") - 0.001).alias("w"), (F.min("lat") - 0.001).alias("s"), (F.max("lon") + 0.001).alias("e"), (F.max("lat") + 0.001).alias("n"))


@query("j5_countries_of_areas", f"select p.locality, string_agg(b.country, '|' order by b.country) as countries from {_LOC} p join {_CBOX} b on p.lon between b.w and b.e and p.lat between b.s and b.n group by p.locality")
def j5(spark, sf):
    rings = country_boxes(spark, sf).select("country", geo.box_rings(*[F.col(c) for c in "wsen"]).alias("rings"))
    met = proximity.points_in_regions(build.locality_points(spark, sf), rings, "locality", "country")
    return met.groupBy("locality").agg(F.array_join(F.array_sort(F.collect_set("country")), "|").alias("countries"))


_RBOX = f"(select region, min(lon) - 0.001 as w, max(lon) + 0.001 as e, min(lat) - 0.001 as s, max(lat) + 0.001 as n from (select distinct rec_id, region, lon, lat from osm_addresses where {OK_} and region is not null) group by region)"


@query("a24_region_groups", f"select p.locality, b.region as within from {_LOC} p join {_BOX} o on o.locality = p.locality join {_RBOX} b on b.region <> p.locality and p.lon between b.w and b.e and p.lat between b.s and b.n and (b.e - b.w) * (b.n - b.s) > (o.e - o.w) * (o.n - o.s)")
def a24(spark, sf):
    """Larger areas of another name that cover an area's point."""
    a = addresses(spark, sf, "region", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("region").isNotNull())
    regions = a.groupBy("region").agg((F.min("lon") - 0.001).alias("w"), (F.min("lat") - 0.001).alias("s"), (F.max("lon") + 0.001).alias("e"), (F.max("lat") + 0.001).alias("n"))
    size = ((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")))
    met = proximity.points_in_regions(build.locality_points(spark, sf), regions.select(F.col("region").alias("within"), geo.box_rings(*[F.col(c) for c in "wsen"]).alias("rings")), "locality", "within")
    inner = build.boxes(spark, sf).select("locality", size.alias("own"))
    outer = regions.select(F.col("region").alias("within"), size.alias("other"))
    return met.filter("locality <> within").join(inner, "locality").join(outer, "within").filter("other > own").select("locality", "within")


@query("j6_places_to_boundaries", f"""with p as (select locality as place, locality as name, case when length(locality) % 3 = 0 then 'Q' || locality end as item, lon, lat from {_LOC}),
 b as (select case when length(locality) % 4 = 0 then upper(locality) else locality end as name, locality as boundary, case when length(locality) % 6 = 0 then 'Q' || locality end as item, w, s, e, n from {_BOX}),
 m as (select p.place, b.boundary, case when p.item = b.item then 1 when p.name = b.name then 2 when lower(p.name) = lower(b.name) then 3 end as how from p join b on p.item = b.item or (lower(p.name) = lower(b.name) and {_INBOX}))
 select place, arg_min(boundary, (how, boundary)) as boundary, cast(min(how) as integer) as how from m group by place""")
def j6(spark, sf):
    """A place point joins the boundary of its item, else the one around it of its name, else of its name in other letters."""
    p = build.locality_points(spark, sf).select(F.col("locality").alias("place"), F.when(F.length("locality") % 3 == 0, F.concat(F.lit("Q"), "locality")).alias("item"), "lon", "lat")
    b = build.boxes(spark, sf).select(
        F.col("locality").alias("boundary"), F.when(F.length("locality") % 4 == 0, F.upper("locality")).otherwise(F.col("locality")).alias("name"), F.when(F.length("locality") % 6 == 0, F.concat(F.lit("Q"), "locality")).alias("item"), "w", "s", "e", "n"
    )
    by_item = p.filter("item is not null").join(b.select("item", "boundary"), "item").select("place", "boundary", F.lit(1).alias("how"))
    over = lambda d: (F.col("lon") + d > F.col("w")) & (F.col("lon") + d < F.col("e"))
    around = (over(0) | over(360) | over(-360)) & (F.col("lat") > F.col("s")) & (F.col("lat") < F.col("n"))
    by_name = p.withColumn("k", F.lower("place")).join(b.withColumn("k", F.lower("name")).drop("item"), "k").filter(around)
    by_name = by_name.select("place", "boundary", F.when(F.col("place") == F.col("name"), 2).otherwise(3).alias("how"))
    best = by_item.unionByName(by_name).groupBy("place").agg(F.min(F.struct("how", "boundary")).alias("m"))
    return best.select("place", "m.boundary", "m.how")


_HOUSES = f"(select rec_id as node, rec_id as place, s, n, coalesce(unit, '') as u, postcode, lon, lat from {_K} where {OK_} and s is not null and n is not null union all select rec_id, 1000000000000 + rec_id, s, n, coalesce(unit, ''), postcode, lon, lat from {_KI} where {OK_} and s is not null and n is not null)"


@query("j7_greedy_houses", f"""with recursive h as (select *, row_number() over (partition by s, n, u order by place) as i from {_HOUSES}),
 e as (select b.node, a.i from h a join h b on a.s = b.s and a.n = b.n and a.u = b.u and a.place < b.place where {DIST} <= 100 or ({DIST} <= 1000 and (a.postcode is null or b.postcode is null or a.postcode = b.postcode))),
 near as (select node, list(i order by i) as before from e group by node), o as (select h.s, h.n, h.u, h.i, h.node, coalesce(near.before, []) as before from h left join near on near.node = h.node),
 r(s, n, u, i, node, leaders, leads) as (select s, n, u, i, node, [i], true from o where i = 1 union all select o.s, o.n, o.u, o.i, o.node, case when list_has_any(r.leaders, o.before) then r.leaders else list_append(r.leaders, o.i) end, not list_has_any(r.leaders, o.before) from r join o on o.s = r.s and o.n = r.n and o.u = r.u and o.i = r.i + 1)
 select node as rec_id, not leads as repeated from r""")
def j7_greedy(spark, sf):
    """J7 in its order: map records first, then rows; a house repeats one only where that one was kept."""
    spatial = lambda k: k.filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("s").isNotNull() & F.col("n").isNotNull())
    cols = ["s", "n", "unit", "postcode", "lon", "lat"]
    a = spatial(keyed(spark, sf, *cols)).withColumn("place", F.col("rec_id"))
    b = spatial(keyed_imports(spark, sf, *cols)).withColumn("place", F.col("rec_id") + 1_000_000_000_000)
    houses = a.unionByName(b).withColumn("u", F.coalesce("unit", F.lit("")))
    # neighbours meet by place and house, not by house alone: a house number of every town's main street stays apart
    step = 0.0125
    rows = F.floor(F.col("lat") / step)
    mine = houses.select("rec_id", "place", "postcode", "lon", "lat", "s", "n", "u", rows.alias("row"))
    ring = mine.withColumn("row", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)))
    other = mine.select("s", "n", "u", "row", *[F.col(c).alias("_" + c) for c in ("rec_id", "place", "postcode", "lon", "lat")])
    met = ring.join(other, ["s", "n", "u", "row"]).filter("place < _place")
    metres = geo.distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    agree = F.col("postcode").isNull() | F.col("_postcode").isNull() | (F.col("postcode") == F.col("_postcode"))
    near = met.filter((metres <= 100) | ((metres <= 1000) & agree)).select(F.col("rec_id").alias("a"), F.col("_rec_id").alias("b"))
    out = elements.greedy_leaders(houses.select(F.col("rec_id").alias("node"), "place"), near)
    return out.select(F.col("node").alias("rec_id"), (F.col("node") != F.col("leader")).alias("repeated"))


_POIS = f"(select id, pname, linked, lon, lat, row_number() over (order by linked desc, id) as place from (select rec_id as id, coalesce(case when regexp_matches({_C('name')}, '\\p{{L}}') then {key(_C('name'))} end, {key(_C('brand'))}) as pname, {_T['wikidata']} is not null as linked, lon, lat from {ADR} where {_PRESET} is not null and {OK_}) where pname is not null)"


@query("a4_resolved_places", f"""with recursive h as (select *, row_number() over (partition by pname order by place) as i from {_POIS}), e as (select b.id, a.i from h a join h b on a.pname = b.pname and a.place < b.place and {DIST} <= 250),
 near as (select id, list(i order by i) as before from e group by id), o as (select h.pname, h.i, h.id, coalesce(near.before, []) as before from h left join near on near.id = h.id),
 r(pname, i, id, leaders, leader) as (select pname, i, id, [i], i from o where i = 1 union all select o.pname, o.i, o.id, case when list_has_any(r.leaders, o.before) then r.leaders else list_append(r.leaders, o.i) end, case when list_has_any(r.leaders, o.before) then list_min(list_intersect(r.leaders, o.before)) else o.i end from r join o on o.pname = r.pname and o.i = r.i + 1)
 select l.id as place_id, count(*) as records, string_agg(cast(r.id as varchar), '|' order by r.id) as aliases from r join h l on l.pname = r.pname and l.i = r.leader group by l.id""")
def a4(spark, sf):
    """Places of one name within 250 m of a leader are one; leaders are taken by prominence, then id; ids are kept as aliases."""
    n = nodes(spark, sf).filter(geo.is_point(F.col("lon"), F.col("lat")))
    named = elements.match_presets(n.select("id", "tags"), presets(spark)).join(n, "id")
    own = elements.tag(F.col("tags"), "name")
    p = named.select("id", F.coalesce(F.when(own.rlike(r"\p{L}"), text.search_key(own)), text.search_key(elements.tag(F.col("tags"), "brand"))).alias("name"), elements.prominence(F.col("tags"))["linked"].alias("linked"), "lon", "lat").filter("name is not null")
    near = relational.close_pairs(p.select("id", "name", "lon", "lat"), ["name"], "id", 250.0)
    place = F.struct((~F.col("linked")).alias("x"), F.col("id"))
    out = elements.greedy_leaders(p.select(F.col("id").alias("node"), place.alias("place")), near)
    return out.groupBy(F.col("leader").alias("place_id")).agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_list("node")), "|").alias("aliases"))


@query("j10_nearest_of_category", f"""select ping_id, rec_id, distance_m, cast(rank as integer) as rank from (select *, row_number() over (partition by ping_id order by distance_m, rec_id) as rank from (select a.ping_id, b.rec_id, round({DIST}, 3) as distance_m, {DIST} as far from {_PINGS} a
 join (select rec_id, lon, lat from {ADR} where {_T['amenity']} = 'pharmacy' and {OK_}) b on abs(a.lat - b.lat) < 0.003) where far <= 300) where rank <= 3""")
def j10(spark, sf):
    """The three nearest places of a category within 300 m."""
    kind = nodes(spark, sf).filter(F.element_at("tags", "amenity") == "pharmacy").select(F.col("id").alias("rec_id"), "lon", "lat")
    return relational.nearest(table(spark, sf, "pings"), kind, 300.0, "ping_id", "rec_id", k=3)


@query("f10_categories", f"select rec_id as id, {_T['shop']} is not null or {_T['amenity']} = 'pharmacy' as held from {ADR} where {_T['shop']} is not null or {_T['amenity']} is not null")
def f10(spark, sf):
    """A bare key holds every value: of ``shop`` and ``amenity:pharmacy``."""
    n = nodes(spark, sf).select("id", F.explode(F.filter(F.array(*[F.concat(F.lit(k + ":"), F.element_at("tags", k)) for k in ("shop", "amenity")]), lambda x: x.isNotNull())).alias("category"))
    held = F.col("category").isin("amenity:pharmacy") | F.split_part("category", F.lit(":"), F.lit(1)).isin("shop")
    return n.groupBy("id").agg(F.max(held).alias("held"))


@query("j13_context_exists", f"select ping_id, count(*) > 0 as held from (select distinct a.ping_id, b.locality from {_PINGS} a join {_LOC} b on abs(a.lat - b.lat) < 0.1 and {DIST} <= 10000) group by ping_id")
def j13(spark, sf):
    """Whether a settlement lies within 10 km; only pings with one are listed."""
    met = proximity.near_points(table(spark, sf, "pings"), build.locality_points(spark, sf), 10_000.0, "ping_id", "locality")
    return met.select("ping_id").distinct().withColumn("held", F.lit(True))


_HEX = "cast('0x' || substr(md5('{tag}:' || rec_id), 1, 8) as bigint) / 4294967296.0"


@query("g17_jitter", f"select rec_id, round(lat + r * cos(t) / 111194.93, 7) as lat, round(lon + r * sin(t) / (111194.93 * greatest(cos(radians(lat)), 0.000001)), 7) as lon from (select *, 50 * sqrt({_HEX.format(tag='r')}) as r, 2 * pi() * {_HEX.format(tag='t')} as t from (select distinct rec_id, lon, lat from osm_addresses where {OK_}))")
def g17(spark, sf):
    """A point moved within 50 m, evenly over the disc, by a seed and its id."""
    u = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:"), F.col("rec_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    a = addresses(spark, sf, "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).withColumn("r", 50 * F.sqrt(u("r"))).withColumn("t", 2 * F.pi() * u("t"))
    metre = 111194.93
    return a.select("rec_id", F.round(F.col("lat") + F.col("r") * F.cos("t") / metre, 7).alias("lat"), F.round(F.col("lon") + F.col("r") * F.sin("t") / (metre * F.greatest(F.cos(F.radians("lat")), F.lit(0.000001))), 7).alias("lon"))
