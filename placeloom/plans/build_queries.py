"""Queries of joins, aggregations, windows and orders of the record build (families J, A, W, O, K, B)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions import geo, text
from placeloom.operators import proximity, relational
from placeloom.plans.catalogue import SQL, query
from placeloom.plans.scalar_queries import _EXTENT, ADR, HAV, IMP, OK_, addresses, imports, key
from placeloom.runtime import table

_ONE = f"(select rec_id, any_value(housenumber) as housenumber, any_value(street) as street, any_value(unit) as unit, any_value(postcode) as postcode, any_value(locality) as locality, any_value(region) as region, any_value(country) as country, any_value(lon) as lon, any_value(lat) as lat, any_value(object_type) as object_type, any_value(object_id) as object_id, any_value(dataset) as dataset from {ADR} group by rec_id)"
DIST = HAV.format(a="a.lon", b="a.lat", c="b.lon", d="b.lat")
_AOK = OK_.replace("lon", "a.lon").replace("lat", "a.lat")


def _keyed(rows, spark: SparkSession, sf: str, columns: tuple[str, ...], number: str) -> DataFrame:
    made = {"s": "street", "n": number}
    read = dict.fromkeys(made.get(c, c) for c in columns if c != "rec_id")
    keys = {c: text.search_key(F.col(made[c])).alias(c) for c in columns if c in made}
    return rows(spark, sf, *read).select("rec_id", *[keys.get(c, c) for c in columns if c != "rec_id"])


def keyed(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """``rec_id`` and the columns asked for of the map's addresses; ``s`` and ``n`` are the keys of street and number."""
    return _keyed(addresses, spark, sf, columns, "housenumber")


def keyed_imports(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The same of the address files."""
    return _keyed(imports, spark, sf, columns, "number")


_K = f"(select *, {key('street')} as s, {key('housenumber')} as n from {ADR})"
_KI = f"(select *, {key('street')} as s, {key('number')} as n from {IMP})"


@query("j1_coordinate_join", f"select i.rec_id, b.lon, b.lat from {_KI} i left join (select s, n, postcode, min(lon) as lon, min(lat) as lat from {_K} where postcode is not null group by all) b on i.s = b.s and i.n = b.n and i.postcode = b.postcode")
def j1(spark, sf):
    known = keyed(spark, sf, "s", "n", "postcode", "lon", "lat").filter("postcode is not null").groupBy("s", "n", "postcode").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    return keyed_imports(spark, sf, "s", "n", "postcode").join(known, ["s", "n", "postcode"], "left").select("rec_id", "lon", "lat")


@query("j2_needed_only", "select distinct id, name from regions where lower(trim(id)) in (select lower(trim(parent)) from regions where parent is not null)")
def j2(spark, sf):
    r = table(spark, sf, "regions")
    needed = r.filter("parent is not null").select(F.lower(F.trim("parent")).alias("k")).distinct()
    return r.select("id", "name", F.lower(F.trim("id")).alias("k")).distinct().join(needed, "k", "left_semi").select("id", "name")


_BOX = f"(select locality, w0 - 0.001 as w, s0 - 0.001 as s, e0 + 0.001 as e, n0 + 0.001 as n from (select locality, {_EXTENT}, min(lat) as s0, max(lat) as n0 from (select distinct rec_id, locality, lon, lat from osm_addresses where {OK_} and locality is not null) group by locality))"
_INBOX = "((p.lon > b.w and p.lon < b.e) or (p.lon + 360 > b.w and p.lon + 360 < b.e) or (p.lon - 360 > b.w and p.lon - 360 < b.e)) and p.lat > b.s and p.lat < b.n"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Box of every locality, however wide; one on the date line has its east beyond 180."""
    a = addresses(spark, sf, "locality", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("locality").isNotNull())
    west, east, _ = geo.extent(F.col("lon"))
    return a.groupBy("locality").agg((west - 0.001).alias("w"), (F.min("lat") - 0.001).alias("s"), (east + 0.001).alias("e"), (F.max("lat") + 0.001).alias("n"))


@query("j4_containment", f"select distinct ping_id, locality from (select distinct ping_id, lon, lat from pings where {OK_}) p join {_BOX} b on {_INBOX}")
def j4(spark, sf):
    rings = boxes(spark, sf).select("locality", geo.box_rings(*[F.col(c) for c in "wsen"]).alias("rings"))
    return proximity.points_in_regions(table(spark, sf, "pings"), rings, "ping_id", "locality")


@query("a6_best_area", f"select ping_id, arg_min(locality, (round((e - w) * (n - s), 9), locality)) as locality, count(*) > 1 as ambiguous from (select distinct ping_id, lon, lat from pings where {OK_}) p join {_BOX} b on {_INBOX} group by ping_id")
def a6(spark, sf):
    sizes = boxes(spark, sf).select("locality", F.struct(F.round((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")), 9), "locality").alias("size"))
    return j4(spark, sf).join(sizes, "locality").groupBy("ping_id").agg(F.min_by("locality", "size").alias("locality"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


_STAR = f"(select l.locality, l.lat as cy, t.k, g.g, l.lon + g.size * cos(2 * pi() * t.k / 24) * (1 + 0.4 * sin(5 * 2 * pi() * t.k / 24)) as x, l.lat + g.size * sin(2 * pi() * t.k / 24) as y from LOCS l, range(25) t(k), (values (0, 0.02), (1, 0.005)) g(g, size))"


@query("g11_point_in_polygon", """with c as CENT, s as (select a.locality, a.cy, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from STAR a join STAR b on a.locality = b.locality and a.g = b.g and b.k = a.k + 1),
 p as (select ping_id, lon + v as x, lat as y from PINGS, (values (-360), (0), (360)) t(v)) select p.ping_id, s.locality from p join s on abs(p.y - s.cy) < 0.03 group by p.ping_id, s.locality
 having sum(case when (s.y0 > p.y) <> (s.y1 > p.y) and p.x < (s.x1 - s.x0) * (p.y - s.y0) / (s.y1 - s.y0) + s.x0 then 1 else 0 end) filter (where abs(p.x - s.x0) < 1) % 2 = 1""")
def g11(spark, sf):
    """Pings inside star-shaped areas with a hole around each locality, the date line included."""
    turn = F.col("k") * (2 * math.pi / 24)
    corner = lambda size: F.struct((F.col("lon") + size * F.cos(turn) * (1 + 0.4 * F.sin(5 * turn))).alias("lon"), (F.col("lat") + size * F.sin(turn)).alias("lat"))
    corners = locality_points(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("locality", "k", corner(0.02).alias("a"), corner(0.005).alias("b"))
    ring = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c])
    stars = corners.groupBy("locality").agg(F.array(ring("a"), ring("b")).alias("rings"))
    return proximity.points_in_regions(table(spark, sf, "pings"), stars, "ping_id", "locality")


_REP = f"""(select distinct a.rec_id from (select * from {_KI} where {OK_}) a join (select * from {_K} where {OK_}) b on a.s = b.s and a.n = b.n
 where {DIST} <= 100 or ({DIST} <= 1000 and (a.postcode is null or b.postcode is null or a.postcode = b.postcode)))"""


def repeated(spark: SparkSession, sf: str) -> DataFrame:
    a = keyed_imports(spark, sf, "s", "n", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")))
    b = keyed(spark, sf, "s", "n", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).select("s", "n", *[F.col(c).alias("_" + c) for c in ("postcode", "lon", "lat")])
    metres = geo.distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    agree = F.col("postcode").isNull() | F.col("_postcode").isNull() | (F.col("postcode") == F.col("_postcode"))
    return a.join(b, ["s", "n"]).filter((metres <= 100) | ((metres <= 1000) & agree)).select("rec_id").distinct()


@query("j7_repeated_houses", f"select rec_id from {_REP}")
def j7(spark, sf):
    return repeated(spark, sf)


@query("j22_new_houses", f"select rec_id, number, street from {IMP} where rec_id not in (select rec_id from {_REP})")
def j22(spark, sf):
    return imports(spark, sf, "number", "street").join(repeated(spark, sf), "rec_id", "left_anti").select("rec_id", "number", "street")


_CENT = f"(select code, mean - 360 * round(mean / 360) as lon, lat from (select upper(country) || ':' || upper(postcode) as code, {_EXTENT}, avg(lat) as lat from (select distinct rec_id, country, postcode, lon, lat from osm_addresses where {OK_} and postcode is not null and country is not null) group by 1))"


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    a = addresses(spark, sf, "postcode", "country", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("postcode").isNotNull() & F.col("country").isNotNull())
    return a.groupBy(F.concat_ws(":", F.upper("country"), F.upper("postcode")).alias("code")).agg(geo.wrap(geo.extent(F.col("lon"))[2]).alias("lon"), F.avg("lat").alias("lat"))


@query("j8_nearest_postcode", f"""select rec_id, arg_min(code, (d, code)) as code, min(d) as distance_m from (select a.rec_id, b.code, round({DIST}, 3) as d from (select * from {ADR} where postcode is null and {OK_}) a join {_CENT} b on abs(a.lat - b.lat) < 0.1)
 where d <= 10000 group by rec_id""")
def j8(spark, sf):
    without = addresses(spark, sf, "postcode", "lon", "lat").filter("postcode is null")
    return relational.nearest(without, centroids(spark, sf), 10_000.0, "rec_id", "code").select("rec_id", "code", "distance_m")


_PINGS = f"(select distinct ping_id, lon, lat from pings where {OK_})"
_ROWS = "cast(floor({t}.lat / 0.0003) as bigint)"


@query("j9_nearest_address", f"""select ping_id, arg_min(rec_id, (d, rec_id)) as rec_id, min(d) as distance_m from (select a.ping_id, b.rec_id, round({DIST}, 3) as d from (select *, {_ROWS.format(t='pings').replace('pings.', '')} as r from {_PINGS}) a
 join (select rec_id, lon, lat, {_ROWS.format(t='x').replace('x.', '')} + v as r from (select distinct rec_id, lon, lat from osm_addresses where {OK_}), (values (-1), (0), (1)) s(v)) b on a.r = b.r where least(abs(a.lon - b.lon), 360 - abs(a.lon - b.lon)) * cos(radians(a.lat)) < 0.0004 or abs(a.lat) > 89) where d <= 30 group by ping_id""")
def j9(spark, sf):
    return relational.nearest(table(spark, sf, "pings"), table(spark, sf, "osm_addresses"), 30.0, "ping_id", "rec_id").select("ping_id", "rec_id", "distance_m")


_LOC = f"(select locality, mean - 360 * round(mean / 360) as lon, lat from (select locality, {_EXTENT}, avg(lat) as lat from (select distinct rec_id, locality, lon, lat from osm_addresses where {OK_} and locality is not null) group by locality))"


def locality_points(spark: SparkSession, sf: str) -> DataFrame:
    a = addresses(spark, sf, "locality", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("locality").isNotNull())
    return a.groupBy("locality").agg(geo.wrap(geo.extent(F.col("lon"))[2]).alias("lon"), F.avg("lat").alias("lat"))


SQL["g11_point_in_polygon"] = SQL["g11_point_in_polygon"].replace("STAR", _STAR).replace("LOCS", "c").replace("CENT", _LOC).replace("PINGS", _PINGS)


@query("j12_context_points", f"""select rec_id, locality, distance_m, cast(rank as integer) as rank from (select *, row_number() over (partition by rec_id order by distance_m, locality) as rank from (
 select a.rec_id, b.locality, round({DIST}, 3) as distance_m from (select distinct rec_id, lon, lat from osm_addresses where {OK_}) a join {_LOC} b on abs(a.lat - b.lat) < 0.5) where distance_m <= 50000) where rank <= 16""")
def j12(spark, sf):
    return relational.nearest(table(spark, sf, "osm_addresses"), locality_points(spark, sf), 50_000.0, "rec_id", "locality", k=16)


@query("a12_nesting_pairs", f"select distinct locality as inner_area, region as outer_area from {ADR} where locality is not null and region is not null union select distinct region, country from {ADR} where region is not null and country is not null")
def a12(spark, sf):
    a = addresses(spark, sf, "locality", "region", "country")
    pairs = lambda x, y: a.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("inner_area"), F.col(y).alias("outer_area"))
    return pairs("locality", "region").unionByName(pairs("region", "country")).distinct()


@query("j17_area_summaries", f"with l as (select locality, cast(count(*) as bigint) as n, mode() within group (order by region) as x from {ADR} group by locality) select a.rec_id, a.locality, l.n as of_locality from {ADR} a left join l on l.locality = a.locality")
def j17(spark, sf):
    a = addresses(spark, sf, "locality")
    sizes = a.filter("locality is not null").groupBy("locality").agg(F.count(F.lit(1)).alias("of_locality"))
    return a.join(sizes, "locality", "left").select("rec_id", "locality", "of_locality")


@query("j18_id_lookup", f"select object_id, min(rec_id) as rec_id from {ADR} where object_id in (select object_id from {ADR} where rec_id % 50 = 0) group by object_id")
def j18(spark, sf):
    a = addresses(spark, sf, "object_id")
    asked = a.filter("rec_id % 50 = 0 and object_id is not null").select("object_id").distinct()
    return a.join(asked, "object_id", "left_semi").groupBy("object_id").agg(F.min("rec_id").alias("rec_id"))


_PIECES = f"(select distinct rec_id, s, locality, lon, lat from {_K} where {OK_} and locality is not null and s is not null)"


@query("j20_road_pieces", f"""with recursive p as (select * from {_PIECES}), e as (select a.rec_id as x, b.rec_id as y from p a join p b on a.s = b.s and a.locality = b.locality and a.rec_id <> b.rec_id and {DIST} <= 200),
r(node, other) as (select rec_id, rec_id from p union select r.node, e.y from r join e on e.x = r.other) select node, min(other) as component from r group by node having count(*) > 1""")
def j20(spark, sf):
    p = keyed(spark, sf, "s", "locality", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).filter("locality is not null and s is not null")
    return relational.connected_components(relational.close_pairs(p, ["s", "locality"], "rec_id", 200.0))


_BUCKETS = "case when d <= 25 then 'exact' when d <= 100 then 'correct' when d <= 500 then 'near' when d <= 5000 then 'off' else 'wrong' end"


@query("a20_geocode_scores", f"""with t as (select dataset, round({HAV.format(a='i.lon', b='i.lat', c='b.lon', d='b.lat')}, 2) as d from (select * from {_KI} where {OK_}) i join (select s, n, min(rec_id) as r, min(lon) as lon, min(lat) as lat from {_K} where {OK_} group by s, n having count(*) = 1) b on i.s = b.s and i.n = b.n),
s as (select dataset, {_BUCKETS} as bucket from t) select dataset, bucket, cast(count(*) as bigint) as n from s group by dataset, bucket union all select 'all', bucket, cast(count(*) as bigint) from s group by bucket""")
def a20(spark, sf):
    truth = keyed(spark, sf, "s", "n", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).groupBy("s", "n").agg(F.min("lon").alias("_lon"), F.min("lat").alias("_lat"), F.count(F.lit(1)).alias("_c")).filter("_c = 1")
    hits = keyed_imports(spark, sf, "dataset", "s", "n", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).join(truth, ["s", "n"])
    d = F.round(geo.distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")), 2)
    bucket = F.when(d <= 25, "exact").when(d <= 100, "correct").when(d <= 500, "near").when(d <= 5000, "off").otherwise("wrong")
    scored = hits.select("dataset", bucket.alias("bucket"))
    both = scored.withColumn("dataset", F.explode(F.array("dataset", F.lit("all"))))
    return both.groupBy("dataset", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("a1_postcode_points", f"""with p as (select distinct country, upper(trim(regexp_replace(postcode, '\\s+', ' ', 'g'))) as code, cast(round(lon * 10000000) as bigint) as x, cast(round(lat * 10000000) as bigint) as y from {ADR} where {OK_} and postcode is not null and country is not null),
h as (select *, md5(concat(x, ',', y)) as h from p), s as (select * from (select *, row_number() over (partition by country, code order by h, x, y) as r from h) where r <= 16),
m as (select a.country, a.code, a.x, a.y, a.h, round(sum({HAV.format(a='a.x / 1e7', b='a.y / 1e7', c='b.x / 1e7', d='b.y / 1e7')}), 2) as far from s a join s b on a.country = b.country and a.code = b.code group by all)
select m.country, m.code, arg_min(m.x, (m.far, m.h)) as lon_e7, arg_min(m.y, (m.far, m.h)) as lat_e7, any_value(c.n) as n from m join (select country, code, cast(count(*) as bigint) as n from p group by all) c on m.country = c.country and m.code = c.code group by m.country, m.code""")
def a1(spark, sf):
    p = addresses(spark, sf, "postcode", "country", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).filter("postcode is not null and country is not null")
    p = p.select("country", text.clean_postcode(F.col("postcode")).alias("code"), geo.e7(F.col("lon")).alias("x"), geo.e7(F.col("lat")).alias("y")).distinct()
    sizes = p.groupBy("country", "code").agg(F.count(F.lit(1)).alias("n"))
    sample = relational.lowest_per_group(p.withColumn("h", F.md5(F.concat_ws(",", "x", "y"))), ["country", "code"], ["h", "x", "y"], 16)
    groups = sample.groupBy("country", "code").agg(F.collect_list(F.struct("x", "y", "h")).alias("g"))

    def far(a):
        metres = lambda b: geo.distance_m(a["x"] / 1e7, a["y"] / 1e7, b["x"] / 1e7, b["y"] / 1e7)
        return F.struct(F.round(F.aggregate("g", F.lit(0.0), lambda s, b: s + metres(b)), 2).alias("far"), a["h"].alias("h"), a["x"].alias("x"), a["y"].alias("y"))

    best = groups.withColumn("m", F.array_min(F.transform("g", far)))
    return best.join(sizes, ["country", "code"]).select("country", "code", F.col("m.x").alias("lon_e7"), F.col("m.y").alias("lat_e7"), "n")


_CELL2 = "cast(floor(lon / 0.02) as bigint) as cx, cast(floor(lat / 0.02) as bigint) as cy"


@query("a2_lent_postcodes", f"with k as (select rec_id, s, postcode, {_CELL2} from {_K} where {OK_} and s is not null) select a.rec_id, string_agg(distinct b.postcode, '|' order by b.postcode) as lent from k a join k b on a.s = b.s and a.cx = b.cx and a.cy = b.cy where a.postcode is null and b.postcode is not null group by a.rec_id")
def a2(spark, sf):
    cell = [F.floor(F.col("lon") / 0.02).alias("cx"), F.floor(F.col("lat") / 0.02).alias("cy")]
    k = keyed(spark, sf, "s", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("s").isNotNull()).select("rec_id", "s", "postcode", *cell)
    stated = k.filter("postcode is not null").groupBy("s", "cx", "cy").agg(F.array_join(F.array_sort(F.collect_set("postcode")), "|").alias("lent"))
    return k.filter("postcode is null").join(stated, ["s", "cx", "cy"]).select("rec_id", "lent")


@query("a3_joined_streets", f"select s, locality, min(rec_id) as first_id, arg_min(street, rec_id) as name, cast(count(*) as bigint) as n, string_agg(distinct street, '|' order by street) as names from {_K} where s is not null and locality is not null group by s, locality")
def a3(spark, sf):
    k = keyed(spark, sf, "s", "street", "locality").filter("s is not null and locality is not null")
    return k.groupBy("s", "locality").agg(
        F.min("rec_id").alias("first_id"), F.min_by("street", "rec_id").alias("name"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("street")), "|").alias("names")
    )


@query("a10_name_dictionary", f"with n as (select {key('street')} as name, country from {ADR} union all select {key('locality')}, country from {ADR}), c as (select name, country, count(*) as k from n where name is not null and country is not null group by all) select name, cast(sum(k) as bigint) as n, arg_min(country, (-k, country)) as country from c group by name")
def a10(spark, sf):
    a = addresses(spark, sf, "street", "locality", "country")
    names = a.select(text.search_key(F.col("street")).alias("name"), "country").unionByName(a.select(text.search_key(F.col("locality")).alias("name"), "country"))
    counts = names.filter("name is not null and country is not null").groupBy("name", "country").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("name").agg(F.sum("k").alias("n"), F.min_by("country", F.struct((-F.col("k")).alias("k"), "country")).alias("country"))


@query("a11_region_keys", f"with c as (select lower(region) as value, locality, count(*) as k from {ADR} where region is not null and locality is not null group by all), t as (select value, sum(k) as total from c group by value) select c.value, c.locality, cast(c.k as bigint) as n from c join t on t.value = c.value where c.k * 5 >= t.total")
def a11(spark, sf):
    c = addresses(spark, sf, "region", "locality").filter("region is not null and locality is not null").groupBy(F.lower("region").alias("value"), "locality").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("value").agg(F.sum("n").alias("total"))
    return c.join(t, "value").filter("n * 5 >= total").select("value", "locality", "n")


@query("a13_street_documents", f"with k as (select s, locality, coalesce(postcode, '') as postcode, n, (row_number() over (partition by s, locality, coalesce(postcode, '') order by n, rec_id) - 1) // 1024 as part from {_K} where s is not null and locality is not null and n is not null) select s, locality, postcode, cast(part as integer) as part, string_agg(distinct n, ' ' order by n) as numbers from k group by s, locality, postcode, part")
def a13(spark, sf):
    k = keyed(spark, sf, "s", "n", "locality", "postcode").filter("s is not null and locality is not null and n is not null").select("rec_id", "s", "locality", F.coalesce("postcode", F.lit("")).alias("postcode"), "n")
    w = Window.partitionBy("s", "locality", "postcode").orderBy("n", "rec_id")
    parts = k.withColumn("part", F.floor((F.row_number().over(w) - 1) / 1024).cast("int"))
    return parts.groupBy("s", "locality", "postcode", "part").agg(F.array_join(F.array_sort(F.collect_set("n")), " ").alias("numbers"))


@query("a16_layer_counts", f"select coalesce(country, '?') as country, object_type, cast(count(*) as bigint) as n, cast(count(postcode) as bigint) as with_postcode, cast(count(distinct locality) as bigint) as localities from {ADR} group by all")
def a16(spark, sf):
    return addresses(spark, sf, "country", "object_type", "postcode", "locality").groupBy(F.coalesce("country", F.lit("?")).alias("country"), "object_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("postcode").alias("with_postcode"), F.countDistinct("locality").alias("localities")
    )


@query("a18_hash_ranked_draw", f"select rec_id, country, cast(r as integer) as rank from (select rec_id, country, row_number() over (partition by country order by sha256('7:' || rec_id), rec_id) as r from {_ONE}) where r <= 20")
def a18(spark, sf):
    a = addresses(spark, sf, "country").withColumn("h", F.sha2(F.concat(F.lit("7:"), F.col("rec_id").cast("string")), 256))
    return relational.lowest_per_group(a, ["country"], ["h", "rec_id"], 20).select("rec_id", "country", "rank")


@query("a21_latency_percentiles", "with v as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as r, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(case when r = ceil(n * 0.5) then value end) as p50, max(case when r = ceil(n * 0.9) then value end) as p90, max(case when r = ceil(n * 0.99) then value end) as p99 from v group by event_type")
def a21(spark, sf):
    """Nearest-rank percentiles; Spark's ``percentile_disc`` sorts value counts, not rows."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return table(spark, sf, "events").filter("value is not null").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


@query("a26_street_aliases", f"select distinct s, case when split_part(s, ' ', -1) in ('street', 'avenue', 'road', 'lane', 'drive', 'place', 'court', 'terrace', 'crescent', 'boulevard') then trim(regexp_replace(s, ' ?[^ ]+$', '')) else split_part(s, ' ', -1) end as alias from {_K} where s is not null and contains(s, ' ') and length(split_part(s, ' ', -1)) >= 4")
def a26(spark, sf):
    words = F.split("s", " ")
    last = F.element_at(words, -1)
    k = keyed(spark, sf, "s").select("s").distinct().filter(F.col("s").contains(" ") & (F.length(last) >= 4))
    types = ["street", "avenue", "road", "lane", "drive", "place", "court", "terrace", "crescent", "boulevard"]
    return k.select("s", F.when(last.isin(types), F.trim(F.regexp_replace("s", " ?[^ ]+$", ""))).otherwise(last).alias("alias")).distinct()


# ---- windows


_NUM = "cast(nullif(regexp_extract(housenumber, '^\\s*([0-9]{1,9})', 1), '') as integer)"
_WK = f"(select rec_id, locality, s, {_NUM} as b, lon, lat from {_K} where {OK_} and locality is not null and s is not null and {_NUM} is not null)"


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    k = keyed(spark, sf, "locality", "s", "housenumber", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).withColumn("b", text.base_number(F.col("housenumber")))
    return k.filter("locality is not null and s is not null and b is not null").select("rec_id", "locality", "s", "b", "lon", "lat")


@query("w1_anchor_pairs", f"select rec_id, next_id, b as start, next_b as stop from (select rec_id, b, lead(rec_id) over w as next_id, lead(b) over w as next_b from {_WK} window w as (partition by locality, s order by b, rec_id)) where next_b > b and (next_b - b) % 2 = 0")
def w1(spark, sf):
    w = Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    p = numbered(spark, sf).withColumn("next_id", F.lead("rec_id").over(w)).withColumn("next_b", F.lead("b").over(w))
    return p.filter("next_b > b and (next_b - b) % 2 = 0").select("rec_id", "next_id", F.col("b").alias("start"), F.col("next_b").alias("stop"))


@query("w2_w3_runs", f"select rec_id, cast(sum(g) over (partition by locality, s order by b, rec_id) as bigint) as run from (select *, case when b - lag(b) over (partition by locality, s order by b, rec_id) <= 2 then 0 else 1 end as g from {_WK})")
def w2(spark, sf):
    w = Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    starts = numbered(spark, sf).withColumn("g", F.when(F.col("b") - F.lag("b").over(w) <= 2, 0).otherwise(1))
    return starts.select("rec_id", F.sum("g").over(w).alias("run"))


@query("w4_cumulative_length", f"select rec_id, round(coalesce(sum(d) over (partition by locality, s order by b, rec_id rows between unbounded preceding and current row), 0), 1) as along_m from (select rec_id, locality, s, b, {HAV.format(a='plon', b='plat', c='lon', d='lat')} as d from (select *, lag(lon) over w as plon, lag(lat) over w as plat from {_WK} window w as (partition by locality, s order by b, rec_id)))")
def w4(spark, sf):
    w = Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    d = numbered(spark, sf).withColumn("d", geo.distance_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")))
    return d.select("rec_id", F.round(F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), 1).alias("along_m"))


@query("w5_w6_w7_ranks", "with e as (select user_id, event_id, value from events where value is not null), r as (select *, row_number() over (partition by user_id order by value desc, event_id) as rank, max(value) over (partition by user_id) as best, lead(value) over (partition by user_id order by value desc, event_id) as next from e) select event_id, cast(rank as integer) as rank, round(value / nullif(best, 0), 6) as share_of_best, round(value - next, 6) as margin, round(1 / log2(rank + 1), 9) as discount from r")
def w5(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = table(spark, sf, "events").filter("value is not null").select("user_id", "event_id", "value")
    r = e.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("value").over(Window.partitionBy("user_id"))).withColumn("next", F.lead("value").over(w))
    return r.select(
        "event_id", "rank", F.round(F.col("value") / F.nullif(F.col("best"), F.lit(0.0)), 6).alias("share_of_best"), F.round(F.col("value") - F.col("next"), 6).alias("margin"), F.round(1 / F.log2(F.col("rank") + 1), 9).alias("discount")
    )


# ---- orders and sets


@query("o4_street_order", f"select rec_id, cast(row_number() over (partition by locality, s order by b, n, rec_id) as integer) as place from (select rec_id, locality, s, n, {_NUM} as b from {_K} where locality is not null and s is not null and {_NUM} is not null)")
def o4(spark, sf):
    k = keyed(spark, sf, "locality", "s", "n", "housenumber").withColumn("b", text.base_number(F.col("housenumber"))).filter("locality is not null and s is not null and b is not null")
    return k.select("rec_id", F.row_number().over(Window.partitionBy("locality", "s").orderBy("b", "n", "rec_id")).alias("place"))


@query("o5_o6_top_events", "select event_id, user_id, value from events where value is not null order by value desc, event_id limit 50")
def o5(spark, sf):
    return table(spark, sf, "events").filter("value is not null").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("o10_o11_union", f"select distinct {key('street')} as s from {ADR} where {key('street')} is not null union select distinct {key('street')} from {IMP} where {key('street')} is not null")
def o10(spark, sf):
    return keyed(spark, sf, "s").select("s").union(keyed_imports(spark, sf, "s").select("s")).filter("s is not null").distinct()


@query("o12_intersect", f"select distinct s from {_K} where s is not null intersect select distinct s from {_KI} where s is not null")
def o12(spark, sf):
    return keyed(spark, sf, "s").select("s").filter("s is not null").intersect(keyed_imports(spark, sf, "s").select("s"))


@query("o13_except", f"select distinct s from {_KI} where s is not null except select distinct s from {_K} where s is not null")
def o13(spark, sf):
    return keyed_imports(spark, sf, "s").select("s").filter("s is not null").distinct().join(keyed(spark, sf, "s").select("s"), "s", "left_anti")


@query("k2_table_checksums", f"select cast(count(*) as bigint) as n, cast(count(distinct rec_id) as bigint) as ids, cast(sum(rec_id) as bigint) as sum_ids, min(md5(coalesce(label, ''))) as low, max(md5(coalesce(label, ''))) as high from {ADR}")
def k2(spark, sf):
    h = F.md5(F.coalesce("label", F.lit("")))
    return addresses(spark, sf, "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_id").alias("ids"), F.sum("rec_id").alias("sum_ids"), F.min(h).alias("low"), F.max(h).alias("high"))
