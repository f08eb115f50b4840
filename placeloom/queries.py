"""Queries of the core operators, on the tables of a data folder, and the SQL that must agree with them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators import hierarchy, proximity, quarantine
from placeloom.plans import answer_queries, build_queries, element_queries, scalar_queries, search_queries  # noqa: F401  (fills the catalogue)
from placeloom.plans.catalogue import QUERIES, SQL
from placeloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
RECORD = "key number street city postcode country lat lon captured note".split()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cycles(table(spark, sf_dir, "regions"))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hierarchy.hierarchy(table(spark, sf_dir, "regions"))
    return out.withColumn("path", F.array_join("path", "/")).drop("below")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, sf_dir, "regions")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.near_points(table(spark, sf_dir, "pings"), table(spark, sf_dir, "osm_addresses"), 30.0, "ping_id", "rec_id")


def p5_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = proximity.near_points(
        table(spark, sf_dir, "pings"), table(spark, sf_dir, "osm_addresses"), 30.0, "ping_id", "rec_id", with_distance=True
    )
    return near.withColumn("distance_m", F.round("distance_m", 2))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarantine.parse_records(table(spark, sf_dir, "batch_lines"), table(spark, sf_dir, "batch_files"), RECORD)
    return rows.filter("reason is not null").select("file_id", F.col("line_no").cast("int").alias("line_no"), "reason")


def p6_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarantine.parse_records(table(spark, sf_dir, "batch_lines"), table(spark, sf_dir, "batch_files"), RECORD)
    return rows.filter("reason is null").drop("reason").withColumn("line_no", F.col("line_no").cast("int"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_distances, p6_found, p6_valid)} | QUERIES


_EDGES = r"""
with recursive ids as (select distinct id from regions where id is not null),
e0 as (select distinct id, lower(regexp_replace(parent, '^[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+|[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+$', '', 'g')) as p from regions where id is not null),
k as (select lower(id) as p, min(id) as up from ids group by 1),
e as (select i.id, min(k.up) as up from ids i left join e0 on e0.id = i.id left join k on k.p = e0.p group by i.id),
walk(id, pos, steps, path) as (
  select id, id, 0, [id] from e
  union all
  select w.id, e.up, w.steps + 1, list_prepend(e.up, w.path) from walk w join e on e.id = w.pos
  where e.up is not null and not list_contains(w.path, e.up)),
last as (select w.* from walk w join (select id, max(steps) as m from walk group by 1) x on x.id = w.id and x.m = w.steps),
ends as (select l.*, e.up as next from last l join e on e.id = l.pos),
looped as (select id, list_min(list_slice(path, 1, list_position(path, next))) as cycle_id, list_slice(path, 1, list_position(path, next)) as ring from ends where next is not null)
"""
_FAR = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_NEAR = f"""
with a as (select distinct ping_id, lon, lat, cast(floor(lat / 0.0003) as bigint) as r from pings
  where abs(lon) <= 180 and abs(lat) <= 90 and not (lon = 0 and lat = 0)),
b as (select distinct rec_id, lon, lat, cast(floor(lat / 0.0003) as bigint) + s.s as r from osm_addresses, (values (-1), (0), (1)) s(s)
  where abs(lon) <= 180 and abs(lat) <= 90 and not (lon = 0 and lat = 0)),
pairs as (select ping_id, rec_id, min({_FAR}) as d from a join b on a.r = b.r
  where least(abs(a.lon - b.lon), 360 - abs(a.lon - b.lon)) * cos(radians(a.lat)) < 0.0004 or abs(a.lat) > 89 group by 1, 2)
"""


_BL = r"[\s\x{a0}\x{3000}\x{feff}]"
_FIELD = r'("(?:[^"]|"")*"|[^"{d}]*)'
_EACH = lambda pattern: "case delimiter " + " ".join(f"when {d} then {pattern(c)}" for d, c in (("','", ","), ("';'", ";"), ("chr(9)", r"\t"), ("'|'", r"\|"))) + " end"
_WIDTHS = r"""
with f as (select file_id, bool_or(header_row) as header_row, max(delimiter) as delimiter, max(column_names) as column_names from batch_files group by file_id),
seen as (select distinct file_id, line_no, raw_line from batch_lines where raw_line is not null and not regexp_full_match(raw_line, 'BLANK*')),
heads as (select file_id, min(line_no) as first, arg_min(raw_line, line_no) as head from seen group by file_id),
d as (select unnest([',', ';', chr(9), '|']) as d, unnest([0, 1, 2, 3]) as i),
w as (select file_id, i, d, length(bare) - length(replace(bare, d, '')) + 1 as w, count(*) as c from (select file_id, regexp_replace(raw_line, '"[^"]*"', '', 'g') as bare from seen), d group by all),
e as (select f.*, heads.first, heads.head from f left join heads using (file_id)),
fits as (select e.file_id, w.i, w.d, case when (e.header_row and e.head is not null) or len(e.column_names) > 0 then sum(w.c) else max(w.c) end as n
 from e join w using (file_id) where w.w > 1 and case when e.header_row and e.head is not null then w.w = length(regexp_replace(e.head, '"[^"]*"', '', 'g')) - length(replace(regexp_replace(e.head, '"[^"]*"', '', 'g'), w.d, '')) + 1 else len(coalesce(e.column_names, [])) = 0 or w.w = len(e.column_names) end group by e.file_id, w.i, w.d, e.header_row, e.head, e.column_names),
best as (select file_id, arg_min(d, (-n, i)) as d from fits group by file_id),
spec as (select e.file_id, coalesce(nullif(e.delimiter, ''), best.d, ',') as delimiter, case when e.header_row then e.first end as first, case when e.header_row then e.head end as head, e.column_names from e left join best using (file_id)),
named as (select file_id, delimiter, first, list_transform(case when head is not null then FIELDS(head) else coalesce(column_names, []) end, lambda x: lower(regexp_replace(regexp_replace(x, '^BLANK+', ''), 'BLANK+$', ''))) as names from spec),
r as (select b.file_id, b.line_no, b.raw_line, delimiter, names from (select distinct file_id, line_no, raw_line from batch_lines where raw_line is not null) b join named using (file_id)
 where (first is null or line_no > first) and (not regexp_full_match(raw_line, 'BLANK*') or contains(raw_line, delimiter))),
q as (select *, GOOD as good, case when GOOD then FIELDS(raw_line) end as fields from r),
v as (select *, nullif(regexp_replace(fields[list_position(names, 'lat')], '^BLANK+|BLANK+$', '', 'g'), '') as lat0, nullif(regexp_replace(fields[list_position(names, 'lon')], '^BLANK+|BLANK+$', '', 'g'), '') as lon0,
 fields[list_position(names, 'country')] as country, nullif(fields[list_position(names, 'captured')], '') as day0 from q),
judged as (select *, case when not good then 'broken_quoting' when len(fields) <> len(names) then 'wrong_column_count'
 when not coalesce(regexp_full_match(lat0, '[+-]?[0-9]+(\.[0-9]+)?') and abs(try_cast(lat0 as double)) <= 90, true) or not coalesce(regexp_full_match(lon0, '[+-]?[0-9]+(\.[0-9]+)?') and abs(try_cast(lon0 as double)) <= 180, true)
 or not coalesce(regexp_full_match(country, '[A-Za-z]{2}'), true) or (day0 is not null and (not regexp_full_match(day0, '[0-9]{4}-[0-9]{2}-[0-9]{2}') or day0 like '0000%' or try_cast(day0 as date) is null)) then 'invalid_value' end as reason from v)
"""
def _fields(text: str) -> str:
    """The fields of a record: each begins with a delimiter once one is put in front."""
    parts = _EACH(lambda d: f"regexp_extract_all({text.join(['chr(1) || ', ''])}, '(?:^\\x01|{d}){_FIELD.replace('{d}', d)}', 1)")
    return f"list_transform({parts}, lambda y: case when y[1] = chr(34) then replace(y[2:-2], chr(34) || chr(34), chr(34)) else y end)"


_GOOD = _EACH(lambda d: f"regexp_full_match(raw_line, '{_FIELD}(?:{d}{_FIELD})*'".replace("{d}", d) + ", 's')")
_RECORDS = re.sub(r"FIELDS\((\w+)\)", lambda m: _fields(m[1]), _WIDTHS).replace("GOOD", _GOOD).replace("BLANK", _BL)


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _EDGES + "select id as entry_id, cycle_id from looped",
        "p3_hierarchy": _EDGES
        + """select d.id as entry_id, case when l.id is null then d.path[1] end as root, case when l.id is null then d.steps end as depth,
  case when l.id is null then array_to_string(d.path, '/') end as path,
  case when l.ring is null or not list_contains(l.ring, d.id) then (select count(*) from walk w where w.pos = d.id) - 1 end as n_descendants, l.cycle_id
from ends d left join looped l on l.id = d.id""",
        "p3_descendants": _EDGES + ", on_ring as (select distinct unnest(ring) as id from looped) select w.pos as ancestor_id, w.id as entry_id, w.steps as distance from walk w where w.steps > 0 and w.id not in (select id from on_ring) and w.pos not in (select id from on_ring)",
        "p6_found": _RECORDS + "select file_id, cast(line_no as integer) as line_no, reason from judged where reason is not null",
        "p6_valid": _RECORDS
        + "select file_id, cast(line_no as integer) as line_no, "
        + ", ".join(f"try_cast({n}0 as double) as {n}" if n in ("lat", "lon") else "try_cast(day0 as date) as captured" if n == "captured" else f"fields[list_position(names, '{n}')] as {n}" for n in RECORD)
        + " from judged where reason is null",
        "s11_delimiters": _RECORDS + "select file_id, delimiter, cast(len(names) as integer) as width from named",
        "p5_found": _NEAR + "select ping_id, rec_id from pairs where d <= 30",
        "p5_distances": _NEAR + "select ping_id, rec_id, round(d, 2) as distance_m from pairs where d <= 30",
    } | SQL
