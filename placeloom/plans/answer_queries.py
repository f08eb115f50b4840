"""Queries of structured answers, names, contexts, batch output and round trips of sources and sinks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import geo, text
from placeloom.operators import relational
from placeloom.operators.search import grows
from placeloom.plans import build_queries as build
from placeloom.plans import search_queries as search
from placeloom.plans.build_queries import _K, _KI, _LOC, DIST, keyed, keyed_imports
from placeloom.plans.catalogue import SQL, query
from placeloom.plans.scalar_queries import _CELLCOLS, _CELLROW, ADR, HAV, IMP, OK_, addresses, imports, key
from placeloom.plans.search_queries import _ADDR, _PLAN, _QS
from placeloom.runtime import Scratch, table
from placeloom.sources import readers, writers
from placeloom.streaming.reverse import reverse_stream

# ---- text

# Cyrillic and Greek letters in Latin.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "yi", "є": "ye", "ґ": "g",
}
GREEK = {
    "ου": "ou", "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}


def kana() -> dict[str, str]:
    """Syllables of both kana in Latin, by the names of their characters; small ya, yu, yo glide into the syllable before."""
    one: dict[str, str] = {}
    for code in [*range(0x3041, 0x3097), *range(0x30A1, 0x30F7)]:
        name = unicodedata.name(chr(code), "")
        if " LETTER " in name and " SMALL " not in name:
            one[chr(code)] = name.rsplit(" ", 1)[1].lower()
    glides = {c: "y" + v[-1] for c, v in zip("ゃゅょャュョ", ("ya", "yu", "yo") * 2)}
    two = {a + b: v[:-1] + g for a, v in one.items() if v.endswith("i") and len(v) > 1 for b, g in glides.items()}
    return two | one


def to_latin(name: Column) -> Column:
    """A name in kana, Cyrillic or Greek in Latin letters; null where it has letters of another script, or nothing to change."""
    out = low = F.lower(name)
    for a, b in (kana() | GREEK | CYRILLIC).items():
        if len(a) > 1 or len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    single = {a: b for a, b in (kana() | GREEK | CYRILLIC).items() if len(a) == len(b) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    return F.when((out != low) & ~out.rlike(r"(?=\p{L})[^\x00-ɏḀ-ỿ]"), out)


def _latin_sql(c: str) -> str:
    out = f"lower({c})"
    table_ = kana() | GREEK | CYRILLIC
    for a, b in table_.items():
        if (len(a) > 1 or len(b) != 1) and not "぀" < a[0] < "㄀":
            out = f"replace({out}, '{a}', '{b}')"
    single = {a: b for a, b in table_.items() if len(a) == len(b) == 1}
    return f"translate({out}, '{''.join(single)}', '{''.join(single.values())}')"


@query("t14_transliteration", f"select rec_id, case when l <> lower(name) and not regexp_matches(l, '[\\x{{370}}-\\x{{1dff}}\\x{{1f00}}-\\x{{1fff}}\\x{{2c00}}-\\x{{2dff}}\\x{{3041}}-\\x{{d7ff}}]') then l end as latin from (select rec_id, name, {_latin_sql('name')} as l from {ADR})")
def t14(spark, sf):
    return addresses(spark, sf, "name").select("rec_id", to_latin(F.col("name")).alias("latin"))


@query("t24_masked_numerals", "select query_id, regexp_replace(lower(q), '[0-9]+', '#', 'g') as masked from (select distinct query_id, q from queries where q is not null)")
def t24(spark, sf):
    """Every numeral of a key as one sign, so that keys differing in numbers alone are one."""
    return table(spark, sf, "queries").select("query_id", "q").filter("q is not null").distinct().select("query_id", F.regexp_replace(F.lower("q"), "[0-9]+", "#").alias("masked"))


@query("t28_direction_spellings", f"""with d as (select * from (values {', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in text.DIRECTIONS.items())}) v(w, o)), s as (select distinct s from {_K} where s is not null), w as (select s, string_split(s, ' ') as w from s),
 e as (select s, unnest(range(1, len(w) + 1)) as i, w from w) select distinct s, spelling from (select s, s as spelling from s union all select e.s, array_to_string(list_concat(list_concat(e.w[1:i - 1], [d.o]), e.w[i + 1:]), ' ') from e join d on d.w = e.w[e.i])""")
def t28(spark, sf):
    """A street's key, and with each of its direction words the other way, short or in full."""
    both = text.DIRECTIONS | {b: a for a, b in text.DIRECTIONS.items()}
    s = keyed(spark, sf, "s").filter("s is not null").select("s").distinct().withColumn("w", F.split("s", " "))
    other = F.filter(F.transform("w", lambda w, i: F.when(text.lookup(both, w).isNotNull(), F.array_join(F.transform("w", lambda v, j: F.when(i == j, text.lookup(both, v)).otherwise(v)), " "))), lambda x: x.isNotNull())
    return s.select("s", F.explode(F.array_distinct(F.concat(F.array("s"), other))).alias("spelling"))


@query("t30_percentiles", "with v as (select client_id, accuracy_m as v, row_number() over (partition by client_id order by accuracy_m) as r, count(*) over (partition by client_id) as n from (select distinct ping_id, client_id, accuracy_m from pings) where accuracy_m is not null and client_id is not null) select client_id, " + ", ".join(f"max(case when r = greatest(1, ceil(n * {p})) then v end) as p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " from v group by client_id")
def t30(spark, sf):
    """Nearest-rank percentiles, ties and hot groups counted by value, not row."""
    p = table(spark, sf, "pings").select("ping_id", "client_id", "accuracy_m").distinct().filter("accuracy_m is not null and client_id is not null")
    return p.groupBy("client_id").agg(*[F.expr(f"percentile_disc({q}) within group (order by accuracy_m)").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)])


@query("q10_text_projection", f"select rec_id, array_to_string(list_filter(string_split({key("concat_ws(' ', housenumber, street, unit)")}, ' '), lambda x, i: list_position(string_split({key("concat_ws(' ', housenumber, street, unit)")}, ' '), x) = i), ' ') as what, array_to_string(list_filter(list_filter(string_split({key("concat_ws(' ', locality, region, postcode)")}, ' '), lambda x, i: list_position(string_split({key("concat_ws(' ', locality, region, postcode)")}, ' '), x) = i), lambda x: not list_contains(string_split(coalesce({key("concat_ws(' ', housenumber, street, unit)")}, ''), ' '), x)), ' ') as where_ from {ADR}")
def q10(spark, sf):
    """What a record is and where it is, each word once, in the first of the two that has it."""
    words = lambda *c: F.array_distinct(F.split(text.search_key(F.concat_ws(" ", *c)), " "))
    a = addresses(spark, sf, "housenumber", "street", "unit", "locality", "region", "postcode").withColumn("a", words("housenumber", "street", "unit"))
    none = F.expr("cast(array() as array<string>)")
    return a.select("rec_id", F.array_join("a", " ").alias("what"), F.array_join(F.array_except(words("locality", "region", "postcode"), F.coalesce("a", none)), " ").alias("where_"))


# ---- structured stage

_CELLS = f"(select rec_id, s, n, {key('locality')} as loc, replace({key('postcode')}, ' ', '') as code, r || ':' || least(cast(floor((cast(round(lon * 10000000) as bigint) + 1800000000) * {_CELLCOLS} / 3600000000) as bigint), {_CELLCOLS} - 1) as cell from (select *, {_CELLROW} as r from {_K} where {OK_}))"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    a = keyed(spark, sf, "s", "n", "locality", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).withColumn("row", geo.cell_row(geo.e7(F.col("lat"))))
    at = F.concat_ws(":", "row", geo.cell_column(F.col("row"), geo.e7(F.col("lon"))))
    return a.select("rec_id", "s", "n", text.search_key(F.col("locality")).alias("loc"), text.compact_postcode(F.col("postcode")).alias("code"), at.alias("cell"))


@query("a14_place_cells", f"with p as (select distinct name, cell from (select loc as name, cell from {_CELLS} union all select code, cell from {_CELLS}) where name is not null) select name, count(*) as cells, case when count(*) <= 4 then string_agg(cell, '|' order by cell) end as list from p group by name")
def a14(spark, sf):
    """Cells of every place name; a place of more than a bound keeps its count alone (its extent stands for it, see g10)."""
    c = cells(spark, sf)
    p = c.select(F.col("loc").alias("name"), "cell").unionByName(c.select(F.col("code").alias("name"), "cell")).filter("name is not null").distinct()
    g = p.groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.array_sort(F.collect_list("cell")).alias("l"))
    return g.select("name", "cells", F.when(F.col("cells") <= 4, F.array_join("l", "|")).alias("list"))


@query("j14_j15_street_in_place", f"""with c as (select * from {_CELLS}), p as (select query_id, street, unnest(string_split(context, '|')) as part from {_PLAN} where street is not null and context <> ''),
 f as (select distinct p.query_id, c.cell from p join c on c.loc = p.part or c.code = replace(p.part, ' ', '')) select p.query_id, c.s as street, c.cell, count(distinct c.rec_id) as houses from (select distinct query_id, street from p) p join c on c.s = p.street join f on f.query_id = p.query_id and f.cell = c.cell group by all""")
def j14(spark, sf):
    """Q16: the cells in which a query's street and the place it names meet. Streets and places meet by cell, not house by house."""
    c = Scratch(spark, "cells").write(cells(spark, sf))
    p = search.plan(search._asked(spark, sf)).filter("street is not null and context <> ''").select("query_id", "street", F.explode(F.split("context", r"\|")).alias("part"))
    names = c.select(F.col("loc").alias("name"), "cell").unionByName(c.select(F.col("code").alias("name"), "cell")).filter("name is not null").distinct()
    forms = p.select("query_id", F.explode(F.array_distinct(F.array("part", F.replace("part", F.lit(" "), F.lit(""))))).alias("name"))
    found = forms.join(names, "name").select("query_id", "cell").distinct()
    streets = c.filter("s is not null").groupBy(F.col("s").alias("street"), "cell").agg(F.countDistinct("rec_id").alias("houses"))
    return p.select("query_id", "street").distinct().join(streets, "street").join(found, ["query_id", "cell"]).select("query_id", "street", "cell", "houses")


_STATED = f"(select i.rec_id, k.rec_id as hit, {key('i.city')} as loc_a, {key('k.locality')} as loc_b, replace({key('i.postcode')}, ' ', '') as code_a, replace({key('k.postcode')}, ' ', '') as code_b from {_KI} i join {_K} k on i.s = k.s and i.n = k.n)"
_AGREE = "case when {a} is null then 'unstated' when {b} is null then 'unknown' when {a} = {b} then 'agrees' else 'contradicts' end"


def agreement(stated: Column, known: Column) -> Column:
    """Q39: how a record's area stands to the one stated."""
    return F.when(stated.isNull(), "unstated").when(known.isNull(), "unknown").when(stated == known, "agrees").otherwise("contradicts")


@query("q39_agreement", f"select rec_id, hit, {_AGREE.format(a='loc_a', b='loc_b')} as locality, {_AGREE.format(a='code_a', b='code_b')} as postcode from {_STATED} where loc_a is null or loc_b is null or loc_a = loc_b")
def q39(spark, sf):
    """A contradicting locality removes an answer, a contradicting postcode is marked, to be ranked last."""
    i = keyed_imports(spark, sf, "s", "n", "city", "postcode").select("rec_id", "s", "n", text.search_key(F.col("city")).alias("loc_a"), text.compact_postcode(F.col("postcode")).alias("code_a"))
    k = keyed(spark, sf, "s", "n", "locality", "postcode").select(F.col("rec_id").alias("hit"), "s", "n", text.search_key(F.col("locality")).alias("loc_b"), text.compact_postcode(F.col("postcode")).alias("code_b"))
    # rows that state a locality meet records of it or of none; only the others meet every record of the house
    stated = i.filter("loc_a is not null").join(k.filter("loc_b is not null").withColumn("loc_a", F.col("loc_b")), ["s", "n", "loc_a"]).unionByName(i.filter("loc_a is not null").join(k.filter("loc_b is null"), ["s", "n"]))
    met = stated.unionByName(i.filter("loc_a is null").join(k, ["s", "n"]))
    return met.select("rec_id", "hit", agreement(F.col("loc_a"), F.col("loc_b")).alias("locality"), agreement(F.col("code_a"), F.col("code_b")).alias("postcode"))


@query("q40_postal_towns", f"select code, string_agg(distinct loc, '|' order by loc) as towns from (select replace({key('postcode')}, ' ', '') as code, {key('locality')} as loc from {ADR}) where code is not null and loc is not null group by code")
def q40(spark, sf):
    a = addresses(spark, sf, "postcode", "locality").select(text.compact_postcode(F.col("postcode")).alias("code"), text.search_key(F.col("locality")).alias("loc"))
    return a.filter("code is not null and loc is not null").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("loc")), "|").alias("towns"))


@query("q41_exact_spelling", f"select i.rec_id, arg_min(k.rec_id, (case when lower(k.street) = lower(i.street) then 0 else 1 end, k.rec_id)) as hit, bool_or(lower(k.street) = lower(i.street)) as exact from {_KI} i join {_K} k on i.s = k.s and i.n = k.n and i.city = k.locality group by i.rec_id")
def q41(spark, sf):
    """Of records that one search key finds, one spelled exactly as asked comes first."""
    i = keyed_imports(spark, sf, "s", "n", "city", "street").select("rec_id", "s", "n", F.col("city").alias("locality"), text.exact_key(F.col("street")).alias("x"))
    k = keyed(spark, sf, "s", "n", "locality", "street").select(F.col("rec_id").alias("hit"), "s", "n", "locality", text.exact_key(F.col("street")).alias("y"))
    met = i.join(k, ["s", "n", "locality"]).withColumn("exact", F.col("x") == F.col("y"))
    best = met.groupBy("rec_id").agg(F.min(F.struct((~F.col("exact")).alias("o"), "hit")).alias("b"))
    return best.select("rec_id", "b.hit", (~F.col("b.o")).alias("exact"))


@query("q19_range_answers", f"""with w as (select rec_id, locality, s, b, lead(b) over x as stop from {build._WK} window x as (partition by locality, s order by b, rec_id)), r as (select * from w where stop > b and (stop - b) % 2 = 0),
 i as (select rec_id, city, s, cast(nullif(regexp_extract(number, '^\\s*([0-9]{{1,9}})', 1), '') as integer) as n from {_KI} where city is not null) select i.rec_id, r.rec_id as range_id, round((i.n - r.b) * 1.0 / (r.stop - r.b), 6) as fraction from i join r on i.city = r.locality and i.s = r.s and i.n between r.b and r.stop and (i.n - r.b) % 2 = 0""")
def q19(spark, sf):
    """A range that holds a number on its step, and how far along it lies."""
    w = build.Window.partitionBy("locality", "s").orderBy("b", "rec_id")
    r = build.numbered(spark, sf).select(F.col("rec_id").alias("range_id"), "locality", "s", "b", F.lead("b").over(w).alias("stop")).filter("stop > b and (stop - b) % 2 = 0")
    i = keyed_imports(spark, sf, "s", "city", "number").select("rec_id", F.col("city").alias("locality"), "s", text.base_number(F.col("number")).alias("m"))
    met = i.join(r, ["locality", "s"]).withColumn("fraction", geo.fraction_of(F.col("b"), F.col("stop"), F.lit(2), F.col("m"))).filter("fraction is not null")
    return met.select("rec_id", "range_id", F.round("fraction", 6).alias("fraction"))


@query("q20_postcode_stretches", f"select s, {key('locality')} as loc, replace({key('postcode')}, ' ', '') as code, round(avg(lat), 5) as lat, cast(count(*) as bigint) as n from {_K} where {OK_} and s is not null and {key('locality')} is not null and {key('postcode')} is not null group by all having max(lon) - min(lon) < 180")
def q20(spark, sf):
    """The middle of a street's addresses in each postcode it runs through."""
    a = keyed(spark, sf, "s", "locality", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")))
    a = a.select("s", text.search_key(F.col("locality")).alias("loc"), text.compact_postcode(F.col("postcode")).alias("code"), "lon", "lat").filter("s is not null and loc is not null and code is not null")
    g = a.groupBy("s", "loc", "code").agg(F.round(F.avg("lat"), 5).alias("lat"), F.count(F.lit(1)).alias("n"), (F.max("lon") - F.min("lon")).alias("wide"))
    return g.filter("wide < 180").drop("wide")


@query("q25_places_by_name_or_id", f"select a.rec_id as asked, b.rec_id, 'id' as how from {ADR} a join {ADR} b on b.id = a.id where a.rec_id % 50 = 0 union select a.rec_id, b.rec_id, 'name' from {ADR} a join {ADR} b on {key('b.name')} = {key('a.name')} and b.locality = a.locality where a.rec_id % 50 = 0")
def q25(spark, sf):
    """Places by id, or by name within a locality; asked for every id divisible by 50."""
    a = addresses(spark, sf, "id", "name", "locality").withColumn("k", text.search_key(F.col("name")))
    asked = a.filter("rec_id % 50 = 0").withColumnRenamed("rec_id", "asked")
    by_id = asked.select("asked", "id").join(a.select("rec_id", "id"), "id").select("asked", "rec_id", F.lit("id").alias("how"))
    by_name = asked.select("asked", "k", "locality").join(a.select("rec_id", "k", "locality"), ["k", "locality"]).select("asked", "rec_id", F.lit("name").alias("how"))
    return by_id.unionByName(by_name).distinct()


_NEARLOC = f"(select rec_id, arg_min(locality, (d, locality)) as near from (select a.rec_id, b.locality, round({DIST}, 3) as d from (select distinct rec_id, lon, lat from osm_addresses where locality is null and {OK_}) a join {_LOC} b on abs(a.lat - b.lat) < 0.5) where d <= 50000 group by rec_id)"


@query("q28_q29_contexts", f"""with c as (select a.rec_id, a.street, coalesce(a.locality, t.town, n.near) as locality, case when a.locality is not null then 'stated' when t.town is not null then 'postcode' when n.near is not null then 'nearby' end as came, a.region, a.country from {ADR} a
 left join (select postcode, arg_min(locality, (-k, locality)) as town from (select postcode, locality, count(*) as k from {ADR} where postcode is not null and locality is not null group by all) group by postcode) t on t.postcode = a.postcode left join {_NEARLOC} n on n.rec_id = a.rec_id)
 select rec_id, locality, came, array_to_string(list_filter([street, locality, region, country], lambda x, i: x is not null and list_position(list_transform([street, locality, region, country], lambda y: lower(y)), lower(x)) = i), ', ') as label from c""")
def q28(spark, sf):
    """The first to fill a slot wins: what the address states, what its postcode's addresses state, then the nearest settlement; parts of a label once."""
    a = addresses(spark, sf, "street", "postcode", "locality", "region", "country", "lon", "lat")
    towns = a.filter("postcode is not null and locality is not null").groupBy("postcode", "locality").agg(F.count(F.lit(1)).alias("k")).groupBy("postcode").agg(F.min_by("locality", F.struct((-F.col("k")).alias("k"), "locality")).alias("town"))
    near = relational.nearest(a.filter("locality is null"), build.locality_points(spark, sf), 50_000.0, "rec_id", "locality").select("rec_id", F.col("locality").alias("near"))
    c = a.join(towns, "postcode", "left").join(near, "rec_id", "left")
    place = F.coalesce("locality", "town", "near")
    came = F.when(F.col("locality").isNotNull(), "stated").when(F.col("town").isNotNull(), "postcode").when(F.col("near").isNotNull(), "nearby")
    parts = F.filter(F.array("street", place, "region", "country"), lambda x: x.isNotNull())
    once = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, F.lower), F.lower(x)) == i + 1)
    return c.select("rec_id", place.alias("locality"), came.alias("came"), F.array_join(once, ", ").alias("label"))


@query("a22_ring_votes", f"""with l as (select {key('locality')} as name, upper(country) as country, count(*) as k from {ADR} where locality is not null and country is not null group by all), s as (select distinct query_id, {key('x')} as part from (select query_id, unnest(string_split(regexp_replace(q, '[,;]| - ', chr(1), 'g'), chr(1))) as x from {_QS})),
 v as (select s.query_id, l.country, count(distinct s.part) as votes from s join l on l.name = s.part group by all), m as (select query_id, max(votes) as best from v group by query_id) select v.query_id, min(v.country) as country, max(m.best) as votes from v join m on m.query_id = v.query_id and v.votes = m.best group by v.query_id having count(*) = 1""")
def a22(spark, sf):
    """The country that most places named by a query agree on, where it is the only one."""
    a = addresses(spark, sf, "locality", "country").select(text.search_key(F.col("locality")).alias("part"), F.upper("country").alias("country")).dropna().distinct()
    said = search._asked(spark, sf).select("query_id", F.explode(F.split("q", r"[,;]| - ")).alias("x")).select("query_id", text.search_key(F.col("x")).alias("part")).distinct()
    votes = said.join(a, "part").groupBy("query_id", "country").agg(F.count(F.lit(1)).alias("votes"))
    ranked = votes.groupBy("query_id").agg(F.max("votes").alias("best"), F.collect_list(F.struct("votes", "country")).alias("v"))  # countries: a short list
    top = ranked.withColumn("v", F.filter("v", lambda x: x["votes"] == F.col("best"))).filter("size(v) = 1")
    return top.select("query_id", F.get("v", F.lit(0))["country"].alias("country"), F.col("best").alias("votes"))


@query("a23_coverage", f"select distinct upper(country) as code, 'country' as layer from {ADR} where country is not null union select distinct upper(country) || '-' || upper(left(region, 3)), 'region' from {ADR} where country is not null and region is not null")
def a23(spark, sf):
    a = addresses(spark, sf, "country", "region").filter("country is not null")
    region = a.filter("region is not null").select(F.concat(F.upper("country"), F.lit("-"), F.upper(F.left("region", F.lit(3)))).alias("code"), F.lit("region").alias("layer"))
    return a.select(F.upper("country").alias("code"), F.lit("country").alias("layer")).unionByName(region).distinct()


@query("a25_answer_keys", f"""with c as (select i.rec_id, k.rec_id as hit, k.lon, k.lat from {_KI} i join (select * from {_K} where {OK_}) k on i.s = k.s and i.n = k.n and (replace({key('i.postcode')}, ' ', '') = replace({key('k.postcode')}, ' ', '') or {key('i.city')} = {key('k.locality')})),
 f as (select a.rec_id, min(a.hit) as hit, max({DIST}) as far from c a join c b on a.rec_id = b.rec_id group by a.rec_id) select rec_id, hit from f where far <= 50""")
def a25(spark, sf):
    """Rows whose candidates by street, number and postcode or locality are all one place, within 50 m; as a box around them says first."""
    i = keyed_imports(spark, sf, "s", "n", "city", "postcode").select("rec_id", "s", "n", text.search_key(F.col("city")).alias("loc"), text.compact_postcode(F.col("postcode")).alias("code"))
    k = keyed(spark, sf, "s", "n", "locality", "postcode", "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat"))).select(F.col("rec_id").alias("hit"), "s", "n", text.search_key(F.col("locality")).alias("loc"), text.compact_postcode(F.col("postcode")).alias("code"), "lon", "lat")
    hits = i.drop("loc").join(k.drop("loc"), ["s", "n", "code"]).select("rec_id", "hit", "lon", "lat").union(i.drop("code").join(k.drop("code"), ["s", "n", "loc"]).select("rec_id", "hit", "lon", "lat")).distinct()
    # all within a hundredth of a degree before any list is made: lists stay short
    near = hits.groupBy("rec_id").agg(F.min("hit").alias("hit"), (F.max("lat") - F.min("lat")).alias("dy"), F.collect_set(F.struct("lon", "lat")).alias("p")).filter("dy < 0.01")
    far = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: geo.distance_m(a["lon"], a["lat"], b["lon"], b["lat"])))))
    return near.filter(far <= 50).select("rec_id", "hit")


@query("a27_admin_aliases", "with n as (select distinct lower(case when length(coalesce(parent, '')) % 2 = 0 then name || ' Region' else name end) as name, kind from regions where name is not null), a as (select distinct name, kind, trim(regexp_replace(name, '(^| )(region|district|county|city|state|province|greater)( |$)', ' ')) as alias from n) select name, kind, alias from a where alias <> name and alias <> '' and not exists (select 1 from n where n.name = a.alias and n.kind <> a.kind)")
def a27(spark, sf):
    """Area names without their type word, unless that names an area of another kind."""
    typed = F.when(F.length(F.coalesce("parent", F.lit(""))) % 2 == 0, F.concat("name", F.lit(" Region"))).otherwise(F.col("name"))
    n = table(spark, sf, "regions").filter("name is not null").select(F.lower(typed).alias("name"), "kind").distinct()
    a = n.withColumn("alias", F.trim(F.regexp_replace("name", "(^| )(region|district|county|city|state|province|greater)( |$)", " ")))
    a = a.filter("alias <> name and alias <> ''")
    other = n.select(F.col("name").alias("alias"), F.col("kind").alias("k")).join(a.select("alias").distinct(), "alias", "left_semi")
    clash = a.join(other, "alias").filter("kind <> k").select("name", "kind", "alias").distinct()
    return a.join(clash, ["name", "kind", "alias"], "left_anti").select("name", "kind", "alias")


@query("o9_context_order", f"select rec_id, array_to_string(list_filter([postcode, locality, region, country], lambda x: x is not null), '|') as areas from {ADR}")
def o9(spark, sf):
    """Areas of a record from the narrowest to the widest."""
    return addresses(spark, sf, "postcode", "locality", "region", "country").select("rec_id", F.concat_ws("|", "postcode", "locality", "region", "country").alias("areas"))


@query("o8_chosen_houses", f"select query_id, doc, cast(row_number() over (partition by query_id order by case when housed then 0 else 1 end, rank) as integer) as place from (select r.query_id, r.doc, r.rank, coalesce(p.number = k.n and p.street = k.s, false) as housed from ({SQL['q11_bm25']}) r left join {_PLAN} p on p.query_id = r.query_id join (select distinct rec_id, s, n from {_K}) k on k.rec_id = r.doc)")
def o8(spark, sf):
    """Answers that carry the house number on the road asked for move first, the others keep their order."""
    p = search.plan(search._asked(spark, sf)).select("query_id", "number", "street")
    k = keyed(spark, sf, "s", "n").withColumnRenamed("rec_id", "doc")
    r = search.q11(spark, sf).join(grows(p), "query_id", "left").join(grows(k), "doc")
    housed = F.coalesce((F.col("number") == F.col("n")) & (F.col("street") == F.col("s")), F.lit(False))
    w = build.Window.partitionBy("query_id").orderBy(F.when(housed, 0).otherwise(1), "rank")
    return r.select("query_id", "doc", F.row_number().over(w).alias("place"))


# ---- batch output, sources and sinks round trip

# Columns of the audit output, in order.
AUDIT = [
    "geocode_" + c for c in (
        "status query score confidence id layer accuracy name label category brand road_class lat lon address_housenumber address_unit address_street address_place address_areas address_locality "
        "address_region address_postcode address_country context_neighbourhood context_locality context_district context_region context_country context_place source_dataset reason"
    ).split()
]


def audit(rows: DataFrame, known: dict[str, Column], keep: list[str]) -> DataFrame:
    """K4: ``keep`` and the audit columns in their order; those not in ``known`` are null."""
    return rows.select(*keep, *[known.get(c.removeprefix("geocode_"), F.lit(None)).cast("string").alias(c) for c in AUDIT])


_FOUND = f"(select i.rec_id, i.number, i.street, i.city, j.hit, k.id, k.label, k.housenumber, k.street as kstreet, k.locality, k.postcode, k.dataset from {IMP} i left join ({SQL['q41_exact_spelling']}) j on j.rec_id = i.rec_id left join {ADR} k on k.rec_id = j.hit)"
_AUDITED = {
    "status": "case when hit is null then 'unmatched' else 'matched' end", "query": "concat_ws(', ', concat_ws(' ', number, street), city)", "id": "id", "layer": "case when hit is not null then 'address' end", "label": "label",
    "address_housenumber": "housenumber", "address_street": "kstreet", "address_locality": "locality", "address_postcode": "postcode", "source_dataset": "dataset", "reason": "case when hit is null then 'no_match' end",
}


@query("k4_audit_columns", f"select rec_id, {', '.join(_AUDITED.get(c.removeprefix('geocode_'), 'cast(null as varchar)') + ' as ' + c for c in AUDIT)} from {_FOUND}")
def k4(spark, sf):
    known = addresses(spark, sf, "id", "label", "housenumber", "street", "locality", "postcode", "dataset").withColumnRenamed("rec_id", "hit").withColumnRenamed("street", "kstreet")
    rows = imports(spark, sf, "number", "street", "city").join(q41(spark, sf).select("rec_id", "hit"), "rec_id", "left").join(known, "hit", "left")
    return audit(rows, {c: F.expr(e) for c, e in _AUDITED.items()}, ["rec_id"])


def _stored(spark: SparkSession, label: str) -> str:
    scratch = Scratch(spark, label)
    return f"{scratch.root}/file"


_LINE = [*readers.FIELDS, "lon", "lat"]


@query("s3_geojson_lines", f"select rec_id, {', '.join(_LINE)} from {IMP}")
def s3(spark, sf):
    """Rows of the address files written as one feature a line and read again; the number carries the row's id."""
    path = _stored(spark, "features")
    rows = imports(spark, sf, *_LINE).withColumn("number", F.concat_ws("\x01", F.col("rec_id").cast("string"), F.coalesce("number", F.lit("\x02"))))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*readers.FIELDS).alias("properties")))
    rows.select(feature.alias("value")).write.option("compression", "gzip").text(path)
    good, _ = readers.geojson_lines(spark, path)
    parts = F.split("number", "\x01")
    return good.select(parts[0].cast("long").alias("rec_id"), F.nullif(parts[1], F.lit("\x02")).alias("number"), *_LINE[1:])


@query("s4_address_csv", f"select rec_id, {', '.join(_LINE)} from {IMP}")
def s4(spark, sf):
    """The same as CSV with its header in capitals."""
    path = _stored(spark, "csv")
    rows = imports(spark, sf, *_LINE).withColumn("number", F.concat_ws("\x01", F.col("rec_id").cast("string"), F.coalesce("number", F.lit("\x02"))))
    rows.select(*[F.col(c).alias(c.upper()) for c in _LINE]).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    parts = F.split("number", "\x01")
    return readers.address_csv(spark, path).select(parts[0].cast("long").alias("rec_id"), F.nullif(parts[1], F.lit("\x02")).alias("number"), *_LINE[1:])


@query("s13_rank_file", "select cast(user_id as integer) as item, views, cast(greatest(1, least(255, floor(1 + 7.5 * log2(views + 1)))) as integer) as importance from (select user_id, count(*) as views from events group by user_id)")
def s13_file(spark, sf):
    """View counts written as the ranks' CSV, one item twice, and read again."""
    path = _stored(spark, "ranks")
    v = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("QRank")).select(F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("Entity"), "QRank")
    v.unionByName(v.withColumn("QRank", F.lit(0).cast("long"))).write.option("header", True).option("compression", "gzip").csv(path)
    return readers.view_ranks(spark, path)


@query("k1_s14_published", f"select rec_id, id, label from {ADR}")
def k1(spark, sf):
    """A table published twice and read back through its pointer."""
    root = _stored(spark, "pack")
    rows = addresses(spark, sf, "id", "label")
    writers.publish(rows.limit(0), root)
    writers.publish(rows, root)
    return writers.published(spark, root)


@query("k3_coordinates_in_order", f"select i.rec_id, i.number, i.street, b.lat, b.lon from {IMP} i left join ({SQL['j1_coordinate_join']}) b on b.rec_id = i.rec_id")
def k3(spark, sf):
    """Rows with coordinates written in, in the order of the input."""
    rows = imports(spark, sf, "number", "street", "lat", "lon").withColumnsRenamed({"lat": "LAT", "lon": "Lon"})
    out = writers.with_coordinates(rows, build.j1(spark, sf), "rec_id").orderBy("rec_id")
    return out.select("rec_id", "number", "street", F.col("LAT").alias("lat"), F.col("Lon").alias("lon"))


@query("stream_reverse", SQL["j9_nearest_address"])
def stream(spark, sf):
    """2.13: pings as a stream, batch by batch, to the sink and read from it."""
    scratch = Scratch(spark, "stream")
    table(spark, sf, "pings").select("ping_id", "ts", "received_at", "client_id", "lon", "lat", "accuracy_m", "distance_m").write.parquet(f"{scratch.root}/in")
    places = table(spark, sf, "osm_addresses").select("rec_id", "lon", "lat").distinct()
    reverse_stream(spark, f"{scratch.root}/in", places, f"{scratch.root}/out", f"{scratch.root}/state").awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out").select("ping_id", "rec_id", "distance_m").distinct()


@query("j21_distances_to_truth", f"select q.query_id, round({HAV.format(a='q.expect_lon', b='q.expect_lat', c='k.lon', d='k.lat')}, 2) as metres from ({SQL['q15_geocode_addresses']}) a join (select distinct query_id, expect_lon, expect_lat from queries where expect_lon is not null and expect_lat is not null) q on q.query_id = a.query_id join (select distinct rec_id, lon, lat from osm_addresses where {OK_}) k on k.rec_id = a.rec_id")
def j21(spark, sf):
    """How far answers lie from the points expected."""
    q = table(spark, sf, "queries").select("query_id", "expect_lon", "expect_lat").filter("expect_lon is not null and expect_lat is not null").distinct()
    k = addresses(spark, sf, "lon", "lat").filter(geo.is_point(F.col("lon"), F.col("lat")))
    return search.q15(spark, sf).join(q, "query_id").join(k, "rec_id").select("query_id", F.round(geo.distance_m(F.col("expect_lon"), F.col("expect_lat"), F.col("lon"), F.col("lat")), 2).alias("metres"))
