"""Queries of forward and reverse geocoding (families Q, H, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import proximity, relational, search
from placeloom.plans import build_queries as build
from placeloom.plans.build_queries import _K, _KI, _LOC, _PINGS, _WK, DIST, keyed, keyed_imports
from placeloom.plans.catalogue import SQL, query
from placeloom.plans.confidence import fit_logistic, rate
from placeloom.plans.scalar_queries import _EXPAND, ADR, DEG, OK_, addresses, key
from placeloom.runtime import Scratch, table

UNIT_WORDS = "flat|unit|apt|apartment|suite|wohnung|whg|piso"
_QS = "(select distinct query_id, q from queries where q is not null)"

# ---- parsing


def plan(queries: DataFrame) -> DataFrame:
    """Q9: the comma-based reading of free text: ``query_id, number, street, context``.

    The first part that isn't a unit is the subject; a number at its start or end is the house number; the parts after
    it are context. Texts without a word give no row.
    """
    parts = F.filter(F.transform(F.split("q", r"[,;]| - "), text.search_key), lambda p: p.isNotNull())
    parts = F.filter(parts, lambda p: ~p.rlike(rf"^({UNIT_WORDS}) [0-9]+[a-z]?$"))
    p = queries.select("query_id", parts.alias("p")).filter("size(p) > 0")
    subject = F.get("p", F.lit(0))
    number = F.coalesce(F.nullif(F.regexp_extract(subject, r"^([0-9]+[a-z]?) ", 1), F.lit("")), F.nullif(F.regexp_extract(subject, r" ([0-9]+[a-z]?)$", 1), F.lit("")))
    street = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(subject, r"^[0-9]+[a-z]? ", ""), r" [0-9]+[a-z]?$", "")), F.lit(""))
    return p.select("query_id", number.alias("number"), text.expand_abbreviations(street).alias("street"), F.array_join(F.slice("p", 2, 99), "|").alias("context"))


_PARTS = f"(select query_id, list_filter(list_filter(list_transform(string_split(regexp_replace(q, '[,;]| - ', chr(1), 'g'), chr(1)), lambda x: {key('x')}), lambda x: x is not null), lambda x: not regexp_full_match(x, '({UNIT_WORDS}) [0-9]+[a-z]?')) as p from {_QS})"
_RAW = f"""(select query_id, coalesce(nullif(regexp_extract(p[1], '^([0-9]+[a-z]?) ', 1), ''), nullif(regexp_extract(p[1], ' ([0-9]+[a-z]?)$', 1), '')) as number,
 nullif(trim(regexp_replace(regexp_replace(p[1], '^[0-9]+[a-z]? ', ''), ' [0-9]+[a-z]?$', '')), '') as street0, array_to_string(p[2:], '|') as context from {_PARTS} where len(p) > 0)"""
_PLAN = "(select r.query_id, number, array_to_string(f, ' ') as street, context from " + _RAW + " r left join " + _EXPAND.replace("TEXT_", "street0").replace("SOURCE_", f"(select query_id as rec_id, street0 from {_RAW} where street0 is not null)") + " x on x.rec_id = r.query_id)"


@query("q9_comma_plan", "select query_id, number, street, context from " + _PLAN)
def q9(spark, sf):
    return plan(_asked(spark, sf))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all queries that have one, redelivered ones once."""
    return table(spark, sf, "queries").select("query_id", "q").filter("q is not null").distinct()


# ---- geocoding by fields


_ADDR = "(select rec_id, n, s as street, " + key("locality") + " as loc, replace(" + key("postcode") + ", ' ', '') as code from " + _K + ")"
_HITS = f"""(select query_id, rec_id, level from (select p.query_id, a.rec_id, case when a.code is not null and contains(replace(p.context, ' ', ''), a.code) then 3 when a.loc is not null and contains(p.context, a.loc) then 2 when p.context = '' then 1 else 0 end as level
 from {_PLAN} p join {_ADDR} a on a.street = p.street and a.n = p.number) where level > 0)"""


def address_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Q15, Q39: addresses with a query's street and number, where the context names their postcode or locality, or is empty.

    Never another house: number and street must be the same. Level 3 postcode, 2 locality, 1 nothing stated.
    """
    p = plan(_asked(spark, sf)).filter("number is not null and street is not null")
    a = keyed(spark, sf, "s", "n", "locality", "postcode").select("rec_id", F.col("n").alias("number"), F.col("s").alias("street"), text.search_key(F.col("locality")).alias("loc"), text.compact_postcode(F.col("postcode")).alias("code"))
    level = (
        F.when(F.coalesce(F.replace("context", F.lit(" "), F.lit("")).contains(F.col("code")), F.lit(False)), 3)
        .when(F.coalesce(F.col("context").contains(F.col("loc")), F.lit(False)), 2)
        .when(F.col("context") == "", 1).otherwise(0)
    )
    return p.join(a, ["street", "number"]).select("query_id", "rec_id", level.alias("level")).filter("level > 0")


@query("q15_geocode_addresses", f"select query_id, min(rec_id) as rec_id, cast(max(level) as integer) as level from (select *, max(level) over (partition by query_id) as best from {_HITS}) where level = best group by query_id")
def q15(spark, sf):
    best = address_hits(spark, sf).groupBy("query_id").agg(F.max(F.struct("level", (-F.col("rec_id")).alias("r"))).alias("b"))
    return best.select("query_id", (-F.col("b.r")).alias("rec_id"), "b.level")


_AREAS = f"(select distinct {key('locality')} as name, 2 as tier from {ADR} where locality is not null union select distinct {key('region')}, 3 from {ADR} where region is not null union select distinct replace({key('postcode')}, ' ', ''), 1 from {ADR} where postcode is not null)"
_SAID = f"(select query_id, {key('x')} as part from (select query_id, unnest(string_split(regexp_replace(q, '[,;]| - ', chr(1), 'g'), chr(1))) as x from {_QS}))"


def fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Q21: the finest area that a part of the query names, postcode before locality before region."""
    a = addresses(spark, sf, "postcode", "locality", "region")
    named = lambda c, t: a.select(c.alias("name"), F.lit(t).alias("tier")).filter("name is not null").distinct()
    areas = named(text.compact_postcode(F.col("postcode")), 1).unionByName(named(text.search_key(F.col("locality")), 2)).unionByName(named(text.search_key(F.col("region")), 3))
    said = _asked(spark, sf).select("query_id", F.explode(F.split("q", r"[,;]| - ")).alias("x")).select("query_id", text.search_key(F.col("x")).alias("part"))
    forms = said.select("query_id", F.explode(F.array_distinct(F.array("part", F.replace("part", F.lit(" "), F.lit(""))))).alias("name"))
    return forms.join(areas, "name").groupBy("query_id").agg(F.min(F.struct("tier", "name")).alias("b")).select("query_id", F.col("b.tier").alias("tier"), F.col("b.name").alias("name"))


_FALL = f"(select query_id, min(tier) as tier, arg_min(name, (tier, name)) as name from {_SAID} s join {_AREAS} a on a.name = s.part or a.name = replace(s.part, ' ', '') group by query_id)"


@query("q21_fallback_areas", f"select query_id, cast(tier as integer) as tier, name from {_FALL}")
def q21(spark, sf):
    return fallback(spark, sf)


@query("q14_forward_geocode", f"""with b as ({SQL['q15_geocode_addresses']}) select query_id, 'address' as kind, cast(rec_id as varchar) as answer from b union all
 select query_id, 'area', name from {_FALL} where query_id not in (select query_id from b)""")
def q14(spark, sf):
    full = q15(spark, sf).select("query_id", F.lit("address").alias("kind"), F.col("rec_id").cast("string").alias("answer"))
    rest = fallback(spark, sf).join(full, "query_id", "left_anti").select("query_id", F.lit("area").alias("kind"), F.col("name").alias("answer"))
    return full.unionByName(rest)


@query("h12_field_groups", f"""with k as (select s, n, replace({key('postcode')}, ' ', '') as code, {key('locality')} as loc, rec_id from {_K}), i as (select rec_id as row_id, s, n, replace({key('postcode')}, ' ', '') as code, {key('city')} as loc from {_KI}),
 a as (select row_id, min(k.rec_id) as hit from i join k on i.s = k.s and i.n = k.n and i.code = k.code group by 1), b as (select row_id, min(k.rec_id) as hit from i join k on i.s = k.s and i.n = k.n and i.loc = k.loc group by 1)
 select i.row_id, coalesce(a.hit, b.hit) as rec_id, case when a.hit is not null then 1 when b.hit is not null then 2 end as from_group from i left join a on a.row_id = i.row_id left join b on b.row_id = i.row_id""")
def h12(spark, sf):
    """The first field group with an answer wins."""
    k = keyed(spark, sf, "s", "n", "postcode", "locality").select("s", "n", text.compact_postcode(F.col("postcode")).alias("code"), text.search_key(F.col("locality")).alias("loc"), F.col("rec_id").alias("hit"))
    i = keyed_imports(spark, sf, "s", "n", "postcode", "city").select(F.col("rec_id").alias("row_id"), "s", "n", text.compact_postcode(F.col("postcode")).alias("code"), text.search_key(F.col("city")).alias("loc"))
    by = lambda c, name: i.join(k.groupBy("s", "n", c).agg(F.min("hit").alias("hit")), ["s", "n", c]).groupBy("row_id").agg(F.min("hit").alias(name))
    both = i.select("row_id").join(by("code", "a"), "row_id", "left").join(by("loc", "b"), "row_id", "left")
    return both.select("row_id", F.coalesce("a", "b").alias("rec_id"), F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).alias("from_group"))


@query("q18_estimated_numbers", f"""with k as (select locality, s, b, rec_id, lon, lat from {_WK}), w as (select locality, s, b, lon, lat, lead(b) over x as b2, lead(lon) over x as lon2, lead(lat) over x as lat2 from k window x as (partition by locality, s order by b, rec_id)),
 i as (select rec_id, city, s, cast(nullif(regexp_extract(number, '^\\s*([0-9]{{1,9}})', 1), '') as integer) as n from {_KI} where city is not null)
 select i.rec_id, i.n as number, round(w.lon + (w.lon2 - w.lon) * (i.n - w.b) / (w.b2 - w.b), 5) as lon, round(w.lat + (w.lat2 - w.lat) * (i.n - w.b) / (w.b2 - w.b), 5) as lat from i join w on i.city = w.locality and i.s = w.s and i.n > w.b and i.n < w.b2""")
def q18(spark, sf):
    """Q18: a missing house number placed between its neighbours on the street."""
    w = build.Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    k = build.numbered(spark, sf)
    spans = k.select("locality", "s", "b", "lon", "lat", *[F.lead(c).over(w).alias(c + "2") for c in ("b", "lon", "lat")]).filter("b2 > b + 1")
    i = keyed_imports(spark, sf, "s", "city", "number").select("rec_id", F.col("city").alias("locality"), "s", text.base_number(F.col("number")).alias("m"))
    met = i.join(spans, ["locality", "s"]).filter("m > b and m < b2")
    part = (F.col("m") - F.col("b")) / (F.col("b2") - F.col("b"))
    return met.select("rec_id", F.col("m").alias("number"), *[F.round(F.col(c) + (F.col(c + "2") - F.col(c)) * part, 5).alias(c) for c in ("lon", "lat")])


# ---- text search


_TERMS = f"(select rec_id as doc, term, count(*) as tf from (select rec_id, unnest(string_split({key("concat_ws(' ', housenumber, street, locality, postcode)")}, ' ')) as term from {ADR}) where term <> '' group by 1, 2)"


@query("q11_bm25", f"""with ix as (select * from {_TERMS}), n as (select count(distinct doc) as n from ix), d as (select term, count(*) as df from ix group by term),
 a as (select distinct query_id, unnest(string_split({key('q')}, ' ')) as term from {_QS}), ad as (select a.query_id, a.term, d.df from a join d on d.term = a.term),
 s as (select ad.query_id, ix.doc, round(sum(ln(1 + (n.n - ad.df + 0.5) / (ad.df + 0.5)) * ix.tf * 2.2 / (ix.tf + 1.2)), 6) as score from ad join ix on ix.term = ad.term cross join n group by 1, 2)
 select query_id, doc, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, doc) as rank from s) where rank <= 5""")
def q11(spark, sf):
    ix = search.index_terms(addresses(spark, sf, "housenumber", "street", "locality", "postcode"), "rec_id", text.search_key(F.concat_ws(" ", "housenumber", "street", "locality", "postcode")))
    return search.bm25_top(ix, _asked(spark, sf), "query_id", text.search_key(F.col("q")))


_VOC = f"(select term, cast(count(*) as bigint) as n from (select unnest(string_split({key('street')}, ' ')) as term from {ADR}) group by term)"


@query("q13_typo_expansion", f"with w as (select distinct unnest(string_split({key('street')}, ' ')) as word from {build.IMP}), v as (select * from {_VOC}) select w.word, v.term as correction, v.n from w left join v o on o.term = w.word join v on left(w.word, 1) = left(v.term, 1) and levenshtein(w.word, v.term) <= case when length(w.word) >= 7 then 2 else 1 end where length(word) >= 4 and not regexp_matches(word, '[0-9]') and not regexp_matches(v.term, '[0-9]') and length(v.term) >= 3 and word <> v.term and v.n > coalesce(o.n, 0)")
def q13(spark, sf):
    words = keyed_imports(spark, sf, "s").select(F.explode(F.split("s", " ")).alias("word"))
    vocabulary = keyed(spark, sf, "s").select(F.explode(F.split("s", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return search.typo_expansion(words, vocabulary)


_TYPED = f"""(select query_id, nullif(regexp_extract(k, '(^| )([0-9]{{1,5}}[a-z]?)( |$)', 2), '') as number, trim(regexp_replace(regexp_replace(k, '(^| )[0-9]{{1,5}}[a-z]?( |$)', ' '), ' +', ' ', 'g')) as words from (select query_id, {key('q')} as k from {_QS}) where k is not null)"""
_LINES = f"(select nullif(concat_ws(' ', s, {key('locality')}, {key('postcode')}), '') as line, n from {_K})"


@query("q12_q22_autocomplete", f"""with t as (select distinct number, words from {_TYPED} where length(words) >= 2), l as (select line, cast(count(*) as bigint) as n, string_split(line, ' ') as w from {_LINES} where line is not null group by line),
 h as (select distinct line, n as number from {_LINES} where line is not null and n is not null),
 p as (select t.words, l.line, l.n, 1 as how from (select distinct words from t) t join l on contains(' ' || l.line, ' ' || t.words)),
 x as (select t.words, l.line, l.n, 2 as how from (select distinct words, string_split(words, ' ') as v from t where words not in (select words from p)) t join l on list_has_all(l.w, v[1:len(v) - 1]) and contains(' ' || l.line, ' ' || v[-1])),
 m as (select t.number, t.words, y.line, y.n, y.how, case when h.line is null then 0 else 1 end as house from t join (select * from p union all select * from x) y on y.words = t.words left join h on h.line = y.line and h.number = t.number),
 r as (select *, row_number() over (partition by number, words order by house desc, n desc, line) as rank from m)
 select q.query_id, r.line as name, r.how, r.house, cast(r.rank as integer) as rank from {_TYPED} q join r on r.words = q.words and r.number is not distinct from q.number where r.rank <= 10""")
def q22(spark, sf):
    k = keyed(spark, sf, "s", "n", "locality", "postcode")
    lines = k.select(F.nullif(F.concat_ws(" ", "s", text.search_key(F.col("locality")), text.search_key(F.col("postcode"))), F.lit("")).alias("line"), F.col("n").alias("number"))
    typed = _asked(spark, sf).select("query_id", text.search_key(F.col("q")).alias("key"))
    return search.autocomplete(typed, lines.filter("line is not null"))


_CATS = {"bakery": "shop:bakery", "library": "amenity:library", "pharmacy": "amenity:pharmacy", "bus stop": "highway:bus_stop", "town hall": "amenity:townhall"}


@query("q23_category_requests", f"select query_id, regexp_extract(k, '^({'|'.join(_CATS)}) ', 1) as word, nullif(trim(regexp_replace(k, '^({'|'.join(_CATS)}) ((near|in|at|by) )?', '')), '') as place from (select query_id, {key('q')} as k from {_QS}) where regexp_matches(k, '^({'|'.join(_CATS)}) ')")
def q23(spark, sf):
    words = "|".join(_CATS)
    k = _asked(spark, sf).withColumn("k", text.search_key(F.col("q"))).filter(F.col("k").rlike(f"^({words}) "))
    return k.select("query_id", F.regexp_extract("k", f"^({words}) ", 1).alias("word"), F.nullif(F.trim(F.regexp_replace("k", f"^({words}) ((near|in|at|by) )?", "")), F.lit("")).alias("place"))


@query("q30_accuracy", f"select rec_id, case when accuracy = 'point' then 'rooftop' when accuracy in ('interpolated', 'estimated') then 'interpolated' when object_type = 'node' then 'rooftop' when object_type in ('way', 'relation') then 'centroid' else 'approximate' end as tier from {ADR}")
def q30(spark, sf):
    tier = F.when(F.col("accuracy") == "point", "rooftop").when(F.col("accuracy").isin("interpolated", "estimated"), "interpolated").when(F.col("object_type") == "node", "rooftop").when(F.col("object_type").isin("way", "relation"), "centroid").otherwise("approximate")
    return addresses(spark, sf, "accuracy", "object_type").select("rec_id", tier.alias("tier"))


# ---- reverse


_STRETCH = "(select rec_id, s, lon, lat, lon2, lat2, b, b2, b2 > b and (b2 - b) % 2 = 0 as ranged from (select rec_id, s, lon, lat, b, lead(b) over w as b2, lead(lon) over w as lon2, lead(lat) over w as lat2 from " + _WK + " window w as (partition by locality, s order by b, rec_id)) where lon2 is not null)"
_WRAP = lambda d: f"({d} - 360 * round(({d}) / 360))"
_MEASURED = f"""(select *, round(sqrt(pow(ax + dx * t, 2) + pow(ay + dy * t, 2)), 3) as metres from (select *, case when dx * dx + dy * dy > 0 then greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) else 0.0 end as t from (
 select p.ping_id, g.rec_id, g.b, g.b2, g.ranged, {_WRAP('g.lon - p.lon')} * cos(radians(p.lat)) * {DEG} as ax, (g.lat - p.lat) * {DEG} as ay, {_WRAP('g.lon2 - g.lon')} * cos(radians(p.lat)) * {DEG} as dx, (g.lat2 - g.lat) * {DEG} as dy
 from {_PINGS} p join {_STRETCH} g on p.lat between least(g.lat, g.lat2) - 0.0004 and greatest(g.lat, g.lat2) + 0.0004 and (abs({_WRAP('p.lon - g.lon')}) <= abs({_WRAP('g.lon2 - g.lon')}) + 0.05 or abs(p.lat) > 85))) where metres <= 30)"""


def stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches between neighbouring house numbers of a street, however long; ``ranged`` where numbers of one side lie between."""
    w = build.Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    ahead = [F.lead(c).over(w).alias(c + "2") for c in ("b", "lon", "lat")]
    k = build.numbered(spark, sf).select("rec_id", "b", "lon", "lat", *ahead).filter("lon2 is not null")
    return k.withColumn("ranged", F.expr("b2 > b and (b2 - b) % 2 = 0"))


@query("j11_nearest_segment", f"select ping_id, cast(arg_min(rec_id, (metres, cast(rec_id as varchar))) as varchar) as rec_id, min(metres) as metres from {_MEASURED} group by ping_id")
def j11(spark, sf):
    shapes = stretches(spark, sf).withColumnRenamed("rec_id", "shape_id")
    near = proximity.near_shapes(table(spark, sf, "pings"), [(0, shapes)], 30.0, "ping_id")
    return near.select("ping_id", F.col("shape_id").alias("rec_id"), "metres")


_NEARLOC = f"(select ping_id, arg_min(locality, (d, locality)) as locality from (select a.ping_id, b.locality, round({DIST}, 3) as d from {_PINGS} a join {_LOC} b on abs(a.lat - b.lat) < 0.5) where d <= 50000 group by ping_id)"
_NEARCODE = f"(select ping_id, arg_min(code, (d, code)) as code from (select a.ping_id, b.code, round({DIST}, 3) as d from {_PINGS} a join {build._CENT} b on abs(a.lat - b.lat) < 0.1) where d <= 10000 group by ping_id)"
_NUMBER = "cast(cast(greatest(b, least(b2, b + cast(round((b2 - b) * t / 2) as bigint) * 2)) as bigint) as varchar)"
_LADDER = {
    "address": f"(select ping_id, cast(arg_min(rec_id, (d, cast(rec_id as varchar))) as varchar) as answer from (select a.ping_id, b.rec_id, round({DIST}, 3) as d from {_PINGS} a join (select distinct rec_id, lon, lat from osm_addresses where {OK_}) b on abs(a.lat - b.lat) < 0.0004) where d <= 30 group by ping_id)",
    "interpolation": f"(select ping_id, arg_min(rec_id || ':' || {_NUMBER}, (metres, cast(rec_id as varchar))) as answer from {_MEASURED} where ranged group by ping_id)",
    "street": f"(select ping_id, cast(arg_min(rec_id, (metres, cast(rec_id as varchar))) as varchar) as answer from {_MEASURED} group by ping_id)",
    "postcode": f"(select ping_id, code as answer from {_NEARCODE})",
    "locality": f"(select ping_id, locality as answer from {_NEARLOC})",
}


def _ladder_sql(layers: list[str]) -> str:
    steps = " ".join(f"left join {_LADDER[x]} {x} on {x}.ping_id = p.ping_id" for x in layers)
    layer = " ".join(f"when {x}.ping_id is not null then '{x}'" for x in layers)
    return f"select p.ping_id, case {layer} else 'none' end as layer, coalesce({', '.join(x + '.answer' for x in layers)}) as answer from (select distinct ping_id from {_PINGS}) p {steps}"


@query("q26_reverse_ladder", _ladder_sql(list(_LADDER)))
def q26(spark, sf):
    return reverse_ladder(spark, sf, table(spark, sf, "pings"))


@query("q27_reverse_layer", _ladder_sql(["postcode"]))
def q27(spark, sf):
    """Only the layer asked for answers."""
    return reverse_ladder(spark, sf, table(spark, sf, "pings"), "postcode")


def reverse_ladder(spark: SparkSession, sf: str, pings: DataFrame, layer: str | None = None) -> DataFrame:
    """Q26, Q27: ``(ping_id, layer, answer)``, the first of address, interpolated number, street (30 m each), postcode (10 km) and locality (50 km).

    ``layer`` names the only one to answer; another name is an error that lists them. The three near layers share one
    join; the area steps see only points still open, written down once.
    """
    if layer not in (None, *_LADDER):
        raise ValueError(f"layer {layer!r}: one of {', '.join(_LADDER)}")
    scratch = Scratch(spark, "reverse")
    points = pings.select("ping_id", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).distinct()
    near, areas = [x for x in ("address", "interpolation", "street") if layer in (None, x)], [x for x in ("postcode", "locality") if layer in (None, x)]
    parts, open_ = [], points
    if near:
        nothing = F.lit(None).cast("double")
        shapes = []
        if "address" in near:
            shapes.append((0, table(spark, sf, "osm_addresses").select(F.col("rec_id").cast("string").alias("shape_id"), "lon", "lat", nothing.alias("lon2"), nothing.alias("lat2")).distinct()))
        if len(near) > 1 or near != ["address"]:
            lines = scratch.write(stretches(spark, sf))
            ends = ["lon", "lat", "lon2", "lat2"]
            if "interpolation" in near:
                # the numbers ride in the id, behind what ties are settled by
                shapes.append((1, lines.filter("ranged").select(F.concat_ws(":", "rec_id", "b", "b2").alias("shape_id"), *ends)))
            if "street" in near:
                shapes.append((2, lines.select(F.col("rec_id").cast("string").alias("shape_id"), *ends)))
        best = proximity.near_shapes(points, shapes, 30.0, "ping_id")
        part = F.split("shape_id", ":")
        low, high = F.get(part, F.lit(1)).cast("long"), F.get(part, F.lit(2)).cast("long")
        number = geo.number_at(low, high, F.lit(2).cast("long"), F.col("t"))
        answer = F.when(F.col("layer") == 1, F.concat_ws(":", F.get(part, F.lit(0)), number.cast("string"))).otherwise(F.col("shape_id"))
        name = F.element_at(F.array(*map(F.lit, ("address", "interpolation", "street"))), F.col("layer") + 1)
        found = scratch.write(best.select("ping_id", name.alias("layer"), answer.alias("answer")))
        parts.append(found)
        open_ = scratch.write(points.join(found, "ping_id", "left_anti"))
    for area, places, reach, key in (("postcode", build.centroids, 10_000.0, "code"), ("locality", build.locality_points, 50_000.0, "locality")):
        if area in areas:
            got = relational.nearest(open_, places(spark, sf), reach, "ping_id", key).select("ping_id", F.lit(area).alias("layer"), F.col(key).alias("answer"))
            got = scratch.write(got)
            parts.append(got)
            open_ = open_.join(got, "ping_id", "left_anti")
    parts.append(open_.select("ping_id", F.lit("none").alias("layer"), F.lit(None).cast("string").alias("answer")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("k6_geojson_features")
def k6(spark, sf):
    a = addresses(spark, sf, "id", "housenumber", "street", "unit", "locality", "region", "country", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")))
    label = text.address_label(*[F.col(c) for c in ("housenumber", "street", "unit", "locality", "region", "country")])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("id"), label.alias("label"), "postcode").alias("properties")))
    return a.select("rec_id", feature.alias("feature")).distinct()


@query("q37_attribution", f"select p.ping_id, string_agg(distinct b.dataset, '|' order by b.dataset) as datasets from ({SQL['j9_nearest_address']}) p join (select distinct rec_id, dataset from osm_addresses) b on b.rec_id = p.rec_id group by p.ping_id")
def q37(spark, sf):
    near = build.j9(spark, sf).select("ping_id", "rec_id")
    sources = addresses(spark, sf, "dataset")
    return near.join(sources, "rec_id").groupBy("ping_id").agg(F.array_join(F.array_sort(F.collect_set("dataset")), "|").alias("datasets"))


@query("q32_confidence")
def q32(spark, sf):
    """A house answered for an import row, rated by how often such answers lie within 100 m of the row's own point."""
    k = keyed(spark, sf, "s", "n", "lon", "lat", "locality", "postcode").filter(geo.is_point(F.col("lon"), F.col("lat")))
    known = k.groupBy("s", "n").agg(F.min("rec_id").alias("hit"), F.min_by("lon", "rec_id").alias("_lon"), F.min_by("lat", "rec_id").alias("_lat"), F.min_by("locality", "rec_id").alias("_loc"), F.min_by("postcode", "rec_id").alias("_code"), F.count(F.lit(1)).alias("c"))
    i = keyed_imports(spark, sf, "s", "n", "city", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).join(known, ["s", "n"])
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    rows = i.select(
        "rec_id", "hit", flag(F.col("c") == 1).alias("only"), flag(text.search_key(F.col("city")) == text.search_key(F.col("_loc"))).alias("town"), flag(text.compact_postcode(F.col("postcode")) == text.compact_postcode(F.col("_code"))).alias("code"),
        flag(geo.distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) <= 100).alias("good"),
    )
    rows = Scratch(spark, "confidence").write(rows)  # each step of the fit reads it again
    weights = fit_logistic(rows, ["only", "town", "code"], "good")
    return rows.select("rec_id", "hit", F.round(rate(weights, ["only", "town", "code"]), 6).alias("confidence"))
