"""Queries of scalar functions, filters and sources (families T, G, F, S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import records
from placeloom.plans.catalogue import query
from placeloom.runtime import table


def imports(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Rows of the address files, redelivered ones once, with the columns asked for: only those are read and shuffled."""
    return table(spark, sf, "import_rows").select("rec_id", *columns).distinct()


def addresses(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Features of the map, redelivered ones once, with the columns asked for: only those are read and shuffled."""
    return table(spark, sf, "osm_addresses").select("rec_id", *columns).distinct()


IMP = "(select distinct * from import_rows)"
ADR = "(select distinct * from osm_addresses)"
_FOLD = "strip_accents(replace(lower({c}), 'ß', 'ss'))"
KEY = "nullif(trim(regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


def key(c: str) -> str:
    return KEY.format(c=c)


def _map(table_: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in table_.items()) + "}"


# ---- text


def _street_query(name: str, column, sql_expr: str, *columns: str):
    @query(name, f"select rec_id, {sql_expr} as value from {IMP}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return imports(spark, sf, *(columns or ("street",))).select("rec_id", column().alias("value"))

    return run


_street_query("t1_search_key", lambda: text.search_key(F.col("street")), key("street"))
_street_query("t2_exact_key", lambda: text.exact_key(F.col("street")), "lower(street)")
_street_query("t3_collapse_whitespace", lambda: text.collapse_whitespace(F.col("street")), "nullif(trim(regexp_replace(street, '\\s+', ' ', 'g')), '')")
_TYPES = "[" + ", ".join(f"'{t}'" for t in text.STREET_TYPES) + "]"
_EXPAND = f"""(with w as (select rec_id, string_split(TEXT_, ' ') as w from SOURCE_),
t as (select rec_id, w, list_transform(w, lambda x, i: case when x = 'st' and (i = 1 or regexp_full_match(w[i - 1], '[0-9]*')) then x else coalesce({_map(text.ABBREVIATIONS)}[x], x) end) as t from w)
select rec_id, list_transform(t, lambda x, i: case when i > 1 and x = w[i] and list_contains({_TYPES}, t[i - 1]) then coalesce({_map(text.DIRECTIONS)}[x], x) else x end) as f from t)"""
_FULL = _EXPAND.replace("TEXT_", key("street")).replace("SOURCE_", IMP)


@query("t4_expand_abbreviations", f"select rec_id, array_to_string(f, ' ') as value from {_FULL}")
def t4(spark, sf):
    return imports(spark, sf, "street").select("rec_id", text.expand_abbreviations(text.search_key(F.col("street"))).alias("value"))


_ORD = ["first", "second", "third", "fifth", "eleventh", "twelfth", "thirtieth", "ninth"]


@query(
    "t5_ordinals_as_numbers",
    """select c_custkey, case c_custkey % 16 when 0 then '1st street' when 1 then '2nd street' when 2 then '3rd street' when 3 then '5th street' when 4 then '11th street' when 5 then '12th street'
 when 6 then '30th street' when 7 then '9th street' when 8 then 'old 21st street east' when 9 then 'old 22nd street east' when 10 then 'old 23rd street east' when 11 then 'old 25th street east'
 when 12 then 'old twenty 11th street east' when 13 then 'old twenty 12th street east' when 14 then 'old twenty 30th street east' else 'old 29th street east' end as value from customer""",
)
def t5(spark, sf):
    word = F.element_at(F.array(*map(F.lit, _ORD)), (F.col("c_custkey") % 8 + 1).cast("int"))
    written = F.when(F.col("c_custkey") % 16 < 8, F.concat(word, F.lit(" st"))).otherwise(F.concat(F.lit("old twenty "), word, F.lit(" st e")))
    return table(spark, sf, "customer").select("c_custkey", text.expand_abbreviations(written).alias("value"))


@query("t6_street_text", f"select rec_id, array_to_string(list_append(f[1:len(f) - 1], coalesce({_map(text.DIRECTIONS)}[f[len(f)]], f[len(f)])), ' ') as value from {_FULL}")
def t6(spark, sf):
    return imports(spark, sf, "street").select("rec_id", text.street_text(text.search_key(F.col("street"))).alias("value"))


@query("t7_street_type_words", f"select word, cast(count(*) as bigint) as n, list_contains({_TYPES}, word) as is_type, regexp_full_match(word, '[0-9]*') as is_number from (select unnest(string_split({key('street')}, ' ')) as word from {IMP}) group by word")
def t7(spark, sf):
    words = imports(spark, sf, "street").select(F.explode(F.split(text.search_key(F.col("street")), " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("is_type", text.is_street_type(F.col("word"))).withColumn("is_number", text.is_numeric(F.col("word")))


@query("t8_number_terms", f"select distinct rec_id, {key('x')} as term from (select rec_id, unnest(string_split(concat(number, ';', rec_id % 7), ';')) as x from {IMP}) where {key('x')} is not null")
def t8(spark, sf):
    listed = F.concat(F.col("number"), F.lit(";"), (F.col("rec_id") % 7).cast("string"))
    return imports(spark, sf, "number").select("rec_id", F.explode(text.number_terms(listed)).alias("term")).distinct()


_street_query("t9_base_number", lambda: text.base_number(F.col("number")), "cast(nullif(regexp_extract(number, '^\\s*([0-9]{1,9})', 1), '') as integer)", "number")


@query("t10_flat_number_term", f"select rec_id, case when not contains({key('unit')}, ' ') then concat_ws(' ', {key('unit')}, {key('number')}) end as value from {IMP}")
def t10(spark, sf):
    return imports(spark, sf, "number", "unit").select("rec_id", text.flat_number_term(F.col("number"), F.col("unit")).alias("value"))


@query("t11_postcode_forms", f"select rec_id, replace({key('postcode')}, ' ', '') as compact, case when postcode is null then null when contains({key('postcode')}, ' ') then concat({key('postcode')}, '|', replace({key('postcode')}, ' ', '')) else {key('postcode')} end as forms from {IMP}")
def t11(spark, sf):
    forms = F.when(F.col("postcode").isNotNull(), F.array_join(text.postcode_forms(F.col("postcode")), "|"))
    return imports(spark, sf, "postcode").select("rec_id", text.compact_postcode(F.col("postcode")).alias("compact"), forms.alias("forms"))


_street_query("t12_clean_postcode", lambda: text.clean_postcode(F.col("postcode")), "case when regexp_matches(upper(nullif(trim(regexp_replace(postcode, '\\s+', ' ', 'g')), '')), '[A-Z0-9]') then upper(nullif(trim(regexp_replace(postcode, '\\s+', ' ', 'g')), '')) end", "postcode")
_street_query("t13_unique_words", lambda: text.unique_words(F.concat_ws(" ", "street", "city", "street")), f"array_to_string(list_filter(string_split({key("concat_ws(' ', street, city, street)")}, ' '), lambda x, i: list_position(string_split({key("concat_ws(' ', street, city, street)")}, ' '), x) = i), ' ')", "street", "city")
_street_query("t15_without_pasted_tags", lambda: text.without_pasted_tags(F.concat(F.col("street"), F.when(F.col("rec_id") % 2 == 0, F.lit("; addr:city=x y")).otherwise(F.lit("")))), "trim(street)")


@query("t16_alternate_names", "select id, lower(n) as name_key, min(n) as alt_name from (select distinct id, unnest(aliases) as n, name from regions where id is not null) where lower(n) <> coalesce(lower(name), '') and n is not null group by id, lower(n)")
def t16(spark, sf):
    names = table(spark, sf, "regions").filter("id is not null").select("id", "name", F.explode("aliases").alias("n"))
    names = names.filter(F.col("n").isNotNull() & (F.lower("n") != F.coalesce(F.lower("name"), F.lit(""))))
    return names.groupBy("id", F.lower("n").alias("name_key")).agg(F.min("n").alias("alt_name"))


@query("t18_wikidata_item", "select c_custkey, case when c_custkey % 3 = 0 then cast(c_custkey as integer) end as item from customer")
def t18(spark, sf):
    tag = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Q").when(F.col("c_custkey") % 3 == 1, "P").otherwise("x"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.wikidata_item(tag).alias("item"))


@query("t19_labels", f"select rec_id, concat_ws(', ', concat_ws(' ', case when unit is not null then 'Unit ' || unit || ',' end, housenumber, street), locality, region, country) as label from {ADR}")
def t19(spark, sf):
    return addresses(spark, sf, "housenumber", "street", "unit", "locality", "region", "country").select("rec_id", text.address_label(*[F.col(c) for c in ("housenumber", "street", "unit", "locality", "region", "country")]).alias("label"))


@query("t20_record_ids", f"select rec_id, 'osm:' || object_type || ':' || object_id as record_id from {ADR}")
def t20(spark, sf):
    return addresses(spark, sf, "object_type", "object_id").select("rec_id", text.record_id(F.col("object_type"), F.col("object_id")).alias("record_id"))


@query("t21_id_numbers", f"select rec_id, object_id as number from {ADR} union all select rec_id, null from {IMP}")
def t21(spark, sf):
    good = addresses(spark, sf, "object_type", "object_id").select("rec_id", text.id_number(text.record_id(F.col("object_type"), F.col("object_id"))).alias("number"))
    return good.unionByName(imports(spark, sf, "dataset").select("rec_id", text.id_number(F.concat(F.col("dataset"), F.lit(":row:1"))).alias("number")))


@query("t27_same_road", f"select a.rec_id as rec_id, cast(count(*) as bigint) as same from (select rec_id, array_to_string(f, ' ') as s from {_FULL}) a join (select rec_id, array_to_string(f, ' ') as s from {_FULL}) b on a.s = b.s group by a.rec_id")
def t27(spark, sf):
    roads = imports(spark, sf, "street").select("rec_id", text.expand_abbreviations(text.search_key(F.col("street"))).alias("s"))
    sizes = roads.groupBy("s").agg(F.count(F.lit(1)).alias("same"))  # counted once a road, not once a pair
    return roads.join(sizes, "s").select("rec_id", "same")


@query("t29_postcode_country", f"select rec_id, case when regexp_full_match(replace({key('postcode')}, ' ', ''), '[a-z]{{2}}[0-9]{{2}}[a-z]{{2}}') then 'XA' when regexp_full_match(replace({key('postcode')}, ' ', ''), '[0-9]{{5}}') then 'XB|XC|XD' end as countries from {IMP}")
def t29(spark, sf):
    compact = text.compact_postcode(F.col("postcode"))
    return imports(spark, sf, "postcode").select("rec_id", F.when(compact.rlike("^[a-z]{2}[0-9]{2}[a-z]{2}$"), "XA").when(compact.rlike("^[0-9]{5}$"), "XB|XC|XD").alias("countries"))


_street_query("t31_placeholder_postcode", lambda: text.placeholder_postcode(F.when(F.col("rec_id") % 10 == 0, "00 000").otherwise(F.col("postcode"))), f"coalesce(case when rec_id % 10 = 0 then true else regexp_full_match(replace({key('postcode')}, ' ', ''), '0+') end, false)", "postcode")


@query("t32_normal_urls", "select distinct id, lower(regexp_replace(regexp_replace(trim(osm_url), '^(https?://)?(www\\.)?', '', 'i'), '/+$', '')) as url from regions")
def t32(spark, sf):
    return table(spark, sf, "regions").select("id", text.normal_url(F.col("osm_url")).alias("url")).distinct()


_ROADS = [r + end for r in [*text.ROAD_CLASSES, *text.ALSO_ROADS, "proposed", ""] for end in ("", "_link")]
_RANKS = ", ".join(f"('{r}', {i}), ('{r}_link', {i})" for i, r in enumerate(text.ROAD_CLASSES)) + ", ('bridleway', 13), ('bridleway_link', 13)"
_PLACES = [*text.PLACE_TIERS, "galaxy"]
_TIERS = ", ".join(f"('{p}', '{t}')" for p, t in text.PLACE_TIERS.items())
_PICK = lambda values, key: "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], cast({key} % {len(values)} as integer) + 1)"


@query(
    "t33_t34_classes",
    f"""select p_partkey, coalesce(r.rank, 16) as road_class, t.tier from (select p_partkey, {_PICK(_ROADS, 'p_partkey')} as road, {_PICK(_PLACES, 'p_partkey')} as place from part) p
 left join (values {_RANKS}) r(road, rank) on r.road = p.road left join (values {_TIERS}) t(place, tier) on t.place = p.place""",
)
def t33(spark, sf):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    place = F.concat(F.lit(" "), F.initcap(pick(_PLACES)))
    return table(spark, sf, "part").select("p_partkey", text.road_class(pick(_ROADS)).alias("road_class"), text.place_tier(place).alias("tier"))


_LICENCES = [
    ("All Rights Reserved", "restricted"), ("CC-BY-NC 4.0", "non_commercial"), ("ODbL 1.0", "permitted"), ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "restricted"),
    ("https://creativecommons.org/licences/by/4.0/", "permitted"), ("For Non-Commercial use only", "non_commercial"), ("No reuse without permission.", "restricted"), ("Decided by hand", "permitted"),
]


@query(
    "s9_licence_terms",
    f"""select p_partkey, case when {_PICK([t for t, _ in _LICENCES], 'p_partkey')} = d.text then d.terms else {_PICK([t for _, t in _LICENCES], 'p_partkey')} end as terms
 from part left join (values ('Brand#11', 'Decided by hand', 'restricted'), ('Brand#12', 'an older text', 'permitted')) d(brand, text, terms) on d.brand = p_brand""",
)
def s9(spark, sf):
    """Rules, and decisions taken by hand for a source while its licence reads as it did."""
    licence = F.element_at(F.array(*[F.lit(t) for t, _ in _LICENCES]), (F.col("p_partkey") % len(_LICENCES) + 1).cast("int"))
    decisions = spark.createDataFrame([("Brand#11", "Decided by hand", "restricted"), ("Brand#12", "an older text", "permitted")], "p_brand string, text string, decided string")
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", licence.alias("licence")).join(decisions, "p_brand", "left")
    return rows.select("p_partkey", text.licence_terms(F.col("licence"), F.col("text"), F.col("decided")).alias("terms"))


# ---- geometry

HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"
DEG = "(6371008.8 * pi() / 180)"
OK_ = "abs(lon) <= 180 and abs(lat) <= 90 and not (lon = 0 and lat = 0)"
_OVER = "case when lon < 0 then lon + 360 else lon end"
_CROSS = f"min(lon) < 0 and max(lon) >= 0 and max({_OVER}) - min({_OVER}) < max(lon) - min(lon)"
_EXTENT = f"case when {_CROSS} then min({_OVER}) else min(lon) end as w0, case when {_CROSS} then max({_OVER}) else max(lon) end as e0, case when {_CROSS} then avg({_OVER}) else avg(lon) end as mean"
PT = f"(select distinct rec_id, lon, lat from osm_addresses where {OK_})"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return addresses(spark, sf, "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")))


@query("g1_g2_distances", f"select rec_id, round({HAV.format(a='lon', b='lat', c='(lon + 0.01)', d='(lat * 0.999)')}, 2) as metres, round(sqrt(pow(0.01 * cos(radians((lat + lat * 0.999) / 2)), 2) + pow(lat * 0.999 - lat, 2)) * {DEG}, 2) as planar from {PT}")
def g1(spark, sf):
    a, b, c, d = F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") * 0.999
    return points(spark, sf).select("rec_id", F.round(geo.distance_m(a, b, c, d), 2).alias("metres"), F.round(geo.planar_m(a, b, c, d), 2).alias("planar"))


@query("g3_project_to_segment", f"""select rec_id, round(t, 4) as t, round(sqrt(pow(ax + dx * t, 2) + pow(ay + dy * t, 2)), 2) as metres from (select *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) as t from (
select rec_id, 0.001 * cos(radians(lat)) * {DEG} as ax, 0.002 * {DEG} as ay, ((rec_id % 9) - 6) * 0.001 * cos(radians(lat)) * {DEG} as dx, -0.003 * {DEG} as dy from {PT}))""")
def g3(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    foot = geo.project_to_segment(lon, lat, lon + 0.001, lat + 0.002, lon + 0.001 + (F.col("rec_id") % 9 - 6) * 0.001, lat - 0.001)
    return points(spark, sf).select("rec_id", foot.alias("f")).select("rec_id", F.round("f.t", 4).alias("t"), F.round("f.metres", 2).alias("metres"))


_CELLROW = "cast(floor((cast(round(lat * 10000000) as bigint) + 900000000) / 90000) as bigint)"
_CELLCOLS = "greatest(cast(floor(cos(radians((r + 0.5) * 90000 / 1e7 - 90.0)) * (360.0 / 0.009)) as bigint), 1)"


@query("g6_map_cells", f"select r as row, least(cast(floor((cast(round(lon * 10000000) as bigint) + 1800000000) * {_CELLCOLS} / 3600000000) as bigint), {_CELLCOLS} - 1) as col, cast(count(*) as bigint) as n from (select *, {_CELLROW} as r from {PT}) group by 1, 2")
def g6(spark, sf):
    at = points(spark, sf).select(geo.cell_row(geo.e7(F.col("lat"))).alias("row"), "lon")
    return at.select("row", geo.cell_column(F.col("row"), geo.e7(F.col("lon"))).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


_N = lambda r: _CELLCOLS.replace("(r + 0.5)", f"({r} + 0.5)")


@query("g7_rings", f"""with a as (select rec_id, r, least(cast(floor((cast(round(lon * 10000000) as bigint) + 1800000000) * {_CELLCOLS} / 3600000000) as bigint), {_CELLCOLS} - 1) as c, {_CELLCOLS} as own from (select *, {_CELLROW} as r from {PT})),
 b as (select *, unnest([r - 1, r, r + 1]) as rr from a), n as (select *, {_N('rr')} as n from b), x as (select rec_id, rr, n, unnest(range(cast(floor((c - 1) * n / own) as bigint), cast(floor((c + 2) * n / own) as bigint) + 1)) as k from n)
 select distinct rec_id, rr as row, cast(((k % n) + n) % n as bigint) as col from x""")
def g7(spark, sf):
    at = points(spark, sf).select("rec_id", geo.cell_row(geo.e7(F.col("lat"))).alias("row"), "lon").withColumn("col", geo.cell_column(F.col("row"), geo.e7(F.col("lon"))))
    return at.select("rec_id", F.explode(geo.ring(F.col("row"), F.col("col"))).alias("c")).select("rec_id", "c.row", F.col("c.column").alias("col"))


@query("g5_hilbert_keys")
def g5(spark, sf):
    return points(spark, sf).select("rec_id", geo.hilbert_key(geo.e7(F.col("lon")), geo.e7(F.col("lat"))).alias("key"))


@query("g8_g9_boxes", f"select rec_id, round(0.99 * sqrt(pow((case when lon >= 10 and lon <= 20 then 0.0 else least(least(abs(lon - 10), 360 - abs(lon - 10)), least(abs(lon - 20), 360 - abs(lon - 20))) end) * cos(radians(greatest(abs(lat), 50.0))), 2) + pow(greatest(40 - lat, lat - 50, 0.0), 2)) * {DEG}, 2) as at_least_m, round((30 / {DEG}) / cos(radians(lat)), 9) as half_lon from {PT}")
def g8(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    bound = geo.box_lower_bound_m(lon, lat, F.lit(10.0), F.lit(40.0), F.lit(20.0), F.lit(50.0))
    return points(spark, sf).select("rec_id", F.round(bound, 2).alias("at_least_m"), F.round(geo.degree_window(lat, 30.0)["lon"], 9).alias("half_lon"))


def _geohash_sql(chars: int) -> str:
    bits = chars * 5
    nx, ny = (bits + 1) // 2, bits // 2
    x = f"least(cast(floor((lon + 180.0) / 360.0 * {2**nx}) as bigint), {2**nx - 1})"
    y = f"least(cast(floor((lat + 90.0) / 180.0 * {2**ny}) as bigint), {2**ny - 1})"
    out = []
    for k in range(chars):
        terms = [f"(({x if (5 * k + j) % 2 == 0 else y}) >> {(nx if (5 * k + j) % 2 == 0 else ny) - 1 - (5 * k + j) // 2} & 1) * {2 ** (4 - j)}" for j in range(5)]
        out.append(f"substr('{geo._BASE32}', cast({' + '.join(terms)} as integer) + 1, 1)")
    return " || ".join(out)


@query("g15_geohashes", f"select rec_id, {_geohash_sql(4)} as geohash4, {_geohash_sql(6)} as geohash6 from {PT}")
def g15(spark, sf):
    return points(spark, sf).select("rec_id", geo.geohash(F.col("lat"), F.col("lon"), 4).alias("geohash4"), geo.geohash(F.col("lat"), F.col("lon"), 6).alias("geohash6"))


@query("g18_range_numbers", "select o_orderkey, cast(greatest(1, least(99, 1 + cast(round(98 * ((o_orderkey % 100) / 99.0) / 2) as bigint) * 2)) as bigint) as number, case when o_orderkey % 120 between 1 and 99 and (o_orderkey % 120 - 1) % 2 = 0 then round((o_orderkey % 120 - 1) / 98.0, 9) end as fraction from orders")
def g18(spark, sf):
    one, last, step = F.lit(1).cast("long"), F.lit(99).cast("long"), F.lit(2).cast("long")
    number = geo.number_at(one, last, step, (F.col("o_orderkey") % 100) / F.lit(99.0))
    fraction = geo.fraction_of(one, last, step, F.col("o_orderkey") % 120)
    return table(spark, sf, "orders").select("o_orderkey", number.alias("number"), F.round(fraction, 9).alias("fraction"))


@query("g20_unit_vectors", f"select rec_id, round(cos(radians(lat)) * cos(radians(lon)), 9) as x, round(cos(radians(lat)) * sin(radians(lon)), 9) as y, round(sin(radians(lat)), 9) as z from {PT}")
def g20(spark, sf):
    v = geo.unit_vector(F.col("lon"), F.col("lat"))
    return points(spark, sf).select("rec_id", *[F.round(v[c], 9).alias(c) for c in "xyz"])


@query("g10_a15_extents", f"select locality, round(mean - 360 * round(mean / 360), 5) as lon, round(lat, 5) as lat, w0 as west, south, e0 - 360 * round(e0 / 360) as east, north, n from (select p.locality, {_EXTENT}, avg(lat) as lat, min(lat) as south, max(lat) as north, cast(count(*) as bigint) as n from (select distinct rec_id, locality, lon, lat from osm_addresses where {OK_}) p where locality is not null group by p.locality)")
def g10(spark, sf):
    """An area on the date line has its west greater than its east."""
    rows = addresses(spark, sf, "locality", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")) & F.col("locality").isNotNull())
    west, east, mean = geo.extent(F.col("lon"))
    return rows.groupBy("locality").agg(
        F.round(geo.wrap(mean), 5).alias("lon"), F.round(F.avg("lat"), 5).alias("lat"), west.alias("west"), F.min("lat").alias("south"), geo.wrap(east).alias("east"), F.max("lat").alias("north"), F.count(F.lit(1)).alias("n")
    )


# ---- filters and sources


@query("s6_row_validation", f"""select rec_id, case when nullif(trim(regexp_replace(number, '\\s+', ' ', 'g')), '') is null then 'missing_number' when nullif(trim(regexp_replace(street, '\\s+', ' ', 'g')), '') is null then 'missing_street'
 when not coalesce({OK_}, false) then 'bad_coordinates' end as reason, nullif(trim(regexp_replace(coalesce(nullif(trim(city), ''), district), '\\s+', ' ', 'g')), '') as locality from {IMP}""")
def s6(spark, sf):
    return records.validate_imports(imports(spark, sf, "number", "street", "city", "district", "lon", "lat")).select("rec_id", "reason", "locality")


@query("k7_rejection_report", f"""select reason, cast(count(*) as bigint) as n from (select case when nullif(trim(regexp_replace(number, '\\s+', ' ', 'g')), '') is null then 'missing_number' when nullif(trim(regexp_replace(street, '\\s+', ' ', 'g')), '') is null then 'missing_street'
 when not coalesce({OK_}, false) then 'bad_coordinates' end as reason from {IMP}) where reason is not null group by reason""")
def k7(spark, sf):
    return records.validate_imports(imports(spark, sf, "number", "street", "city", "district", "lon", "lat")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s8_sources_by_coverage", "with c as (select dataset, path, entry, area, row_number() over (partition by dataset order by path desc, entry desc nulls last) as n from address_files) select dataset, path, country, case when dataset like 'openaddresses:' || lower(country) || '/0%' then 1 else 2 end as rank from c join (values ('XA'), ('XC')) v(country) on c.dataset like 'openaddresses:' || lower(country) || '/%' where n = 1")
def s8(spark, sf):
    covered = spark.createDataFrame([("XA",), ("XC",)], "country string")
    return records.sources_for(table(spark, sf, "address_files"), covered)


@query("s11_delimiters", None)
def s11(spark, sf):
    from placeloom.operators import quarantine
    from placeloom.runtime import Scratch

    spec = quarantine.file_specs(table(spark, sf, "batch_lines"), table(spark, sf, "batch_files"), Scratch(spark, "delimiters"))
    return spec.select("file_id", "delimiter", F.size("columns").alias("width"))


@query("s13_view_ranks", "select user_id, cast(count(*) as bigint) as views, cast(greatest(1, least(255, floor(1 + 7.5 * log2(count(*) + 1)))) as integer) as importance from events group by user_id")
def s13(spark, sf):
    views = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("views"))
    return views.withColumn("importance", records.importance(F.col("views")))


@query("f7_f8_filters", f"select rec_id from {ADR} where upper(country) in ('XA', 'XC') and {OK_} and lon between -70 and 30 and lat between -20 and 60")
def f7(spark, sf):
    return addresses(spark, sf, "country", "lon", "lat").filter(F.upper("country").isin("XA", "XC") & geo.is_point(F.col("lon"), F.col("lat")) & F.col("lon").between(-70, 30) & F.col("lat").between(-20, 60)).select("rec_id")


@query("f11_query_bounds", "select query_id, case when q is null or trim(regexp_replace(q, '[\\s\\x{a0}]+', ' ', 'g')) = '' then 'missing' when length(trim(regexp_replace(q, '\\s+', ' ', 'g'))) > 256 then 'too_long' else 'ok' end as verdict from (select distinct query_id, q from queries)")
def f11(spark, sf):
    q = text.collapse_whitespace(F.regexp_replace("q", " ", " "))
    verdict = F.when(q.isNull(), "missing").when(F.length(text.collapse_whitespace(F.col("q"))) > 256, "too_long").otherwise("ok")
    return table(spark, sf, "queries").select("query_id", "q").distinct().select("query_id", verdict.alias("verdict"))


@query("f11_coordinate_bounds", "select ping_id, case when lon is null or lat is null then 'missing' when isnan(lon) or isnan(lat) or abs(lon) > 180 or abs(lat) > 90 then 'out_of_range' else 'ok' end as verdict from (select distinct ping_id, lon, lat from pings)")
def f11_points(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    verdict = F.when(lon.isNull() | lat.isNull(), "missing").when(F.isnan(lon) | F.isnan(lat) | (F.abs(lon) > 180) | (F.abs(lat) > 90), "out_of_range").otherwise("ok")
    return table(spark, sf, "pings").select("ping_id", "lon", "lat").distinct().select("ping_id", verdict.alias("verdict"))


@query("f12_source_area", f"""with f as (select i.*, a.area from {IMP} i join (select distinct dataset, area from address_files where area is not null) a using (dataset)),
b as (select country, min(lon) - 1 as w, max(lon) + 1 as e, min(lat) - 1 as s, max(lat) + 1 as n from (select distinct rec_id, country, lon, lat from osm_addresses where {OK_}) group by country),
j as (select f.dataset, f.file_row, f.rec_id, coalesce(f.lon between b.w and b.e and f.lat between b.s and b.n, false) as inside from f join b on b.country = f.area),
m as (select dataset, avg(case when inside then 1.0 else 0.0 end) as share from (select *, row_number() over (partition by dataset order by file_row, rec_id) as r from j) where r <= 1000 group by dataset)
select j.rec_id, j.dataset from j join m using (dataset) where m.share >= 0.5 and j.inside""")
def f12(spark, sf):
    places = addresses(spark, sf, "country", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")))
    boxes = places.groupBy("country").agg((F.min("lon") - 1).alias("w"), (F.max("lon") + 1).alias("e"), (F.min("lat") - 1).alias("s"), (F.max("lat") + 1).alias("n"))
    return records.within_stated_area(imports(spark, sf, "dataset", "file_row", "lon", "lat"), table(spark, sf, "address_files"), boxes)


@query("f15_strictest_level", f"""with c as (select query_id, a.rec_id, case when a.postcode is not null and contains({_FOLD.format(c='q')}, lower(a.postcode)) then 3 when a.locality is not null and contains({_FOLD.format(c='q')}, {_FOLD.format(c='a.locality')}) then 2 else 1 end as level
from (select distinct query_id, q from queries where q is not null) q join (select distinct rec_id, housenumber, postcode, locality, {key('street')} as s from osm_addresses) a
on a.s = array_to_string(list_filter(string_split({key("split_part(q, ',', 1)")}, ' '), lambda x: not regexp_matches(x, '^[0-9]+[a-z]?$')), ' ') and a.s <> '' and regexp_extract({key('housenumber')}, '^[0-9]+') = regexp_extract({key("split_part(q, ',', 1)")}, '[0-9]+'))
select query_id, rec_id, level from (select *, max(level) over (partition by query_id) as best from c) where level = best""")
def f15(spark, sf):
    first = text.search_key(F.split_part("q", F.lit(","), F.lit(1)))
    q = table(spark, sf, "queries").select("query_id", "q").filter("q is not null").distinct()
    q = q.withColumn("s", F.array_join(F.filter(F.split(first, " "), lambda w: ~w.rlike("^[0-9]+[a-z]?$")), " ")).withColumn("n", F.regexp_extract(first, "[0-9]+", 0)).filter("s <> ''")
    a = addresses(spark, sf, "housenumber", "postcode", "locality", "street").withColumn("s", text.search_key(F.col("street"))).drop("street").withColumn("n", F.regexp_extract(text.search_key(F.col("housenumber")), "^[0-9]+", 0))
    said = text.latin(F.col("q"))
    level = F.when(F.coalesce(said.contains(F.lower("postcode")), F.lit(False)), 3).when(F.coalesce(said.contains(text.latin(F.col("locality"))), F.lit(False)), 2).otherwise(1)
    return records.strictest(q.join(a, ["s", "n"]).withColumn("level", level), "query_id", "level").select("query_id", "rec_id", "level")
