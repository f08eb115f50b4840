"""Keys and normal forms of names, streets, numbers and postcodes, as column expressions.

All run inside the JVM. Null in, null out, unless stated; a text without any letter or digit has a null key.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street-type abbreviations, street types, directions, ordinals and tens of normalised English text.
ABBREVIATIONS = {
    "ave": "avenue", "av": "avenue", "blvd": "boulevard", "cir": "circle", "ct": "court", "crt": "court", "cres": "crescent", "gdns": "gardens",
    "grv": "grove", "hts": "heights", "dr": "drive", "hwy": "highway", "ln": "lane", "pkwy": "parkway", "pl": "place", "rd": "road", "sq": "square",
    "st": "street", "ter": "terrace", "terr": "terrace", "trl": "trail", "tr": "trail", "wy": "way",
}
STREET_TYPES = [
    "avenue", "boulevard", "circle", "close", "court", "crescent", "crossing", "drive", "esplanade", "gardens", "gate", "grove", "heights", "highway",
    "hill", "lane", "line", "mews", "parkway", "path", "place", "promenade", "quay", "ridge", "road", "row", "square", "street", "terrace", "trail",
    "walk", "way",
]
DIRECTIONS = {"e": "east", "n": "north", "s": "south", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth",
    "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
# How licences name their terms; the Creative Commons ones by their short names, with "cc" or in an address.
CC_RESTRICTED = ["by nd", "by nc nd"]
CC_NON_COMMERCIAL = ["by nc"]
WORDS_RESTRICTED = ["all rights reserved", "without permission", "prohibited", "no derivatives"]
WORDS_NON_COMMERCIAL = ["non commercial", "noncommercial", "not for commercial"]


def latin_table() -> tuple[str, str, dict[str, str]]:
    """Letters with one Latin base letter, that letter, and those with several: by rule from canonical decomposition."""
    one, base = [], []
    many = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
    for code in range(0xC0, 0x250):
        ch = chr(code).lower()
        letters = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
        if len(ch) == len(letters) == 1 and letters[0].isascii() and letters[0] != ch and ch not in one:
            one.append(ch)
            base.append(letters[0])
    for ch, b in {"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ħ": "h", "ð": "d"}.items():
        one.append(ch)
        base.append(b)
    return "".join(one), "".join(base), many


_ONE, _BASE, _MANY = latin_table()


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def collapse_whitespace(c: Column) -> Column:
    """Single blanks, none at the ends; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def latin(c: Column) -> Column:
    c = F.translate(F.lower(c), _ONE, _BASE)
    for ch, b in _MANY.items():
        c = F.replace(c, F.lit(ch), F.lit(b))
    return F.regexp_replace(c, r"\p{M}+", "")


def search_key(c: Column) -> Column:
    """Lower case, Latin letters without accents, words of letters and digits joined by one blank."""
    return F.nullif(F.trim(F.regexp_replace(latin(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def exact_key(c: Column) -> Column:
    """Lower case, accents kept."""
    return F.lower(c)


def is_numeric(word: Column) -> Column:
    return word.rlike("^[0-9]*$")


def is_street_type(word: Column) -> Column:
    return word.isin(STREET_TYPES)


def let(value: Column, use) -> Column:
    """An expression over a value that is computed once: inside a lambda its array would be built for every element."""
    return F.transform(F.array(value), use)[0]


def _words(key: Column) -> Column:
    return F.split(key, " ")


def expand_abbreviations(key: Column) -> Column:
    """T4 and T5, on a search key: street types and the directions behind them in full, ordinals before a type as numbers.

    "elm rd n" is "elm road north"; an initial "st" or one behind a number stays; "thirty second lane" is "32nd lane".
    """
    at = lambda a, i: F.get(a, i)
    types, directions = ABBREVIATIONS, DIRECTIONS
    numbers = {w: str(i + 1) for i, w in enumerate(ORDINALS)} | {w[:-1] + "ieth": str(20 + 10 * i) for i, w in enumerate(TENS)}
    tens = {w: str(20 + 10 * i) for i, w in enumerate(TENS)}

    def typed(words):
        return F.transform(words, lambda w, i: F.when((w == "st") & ((i == 0) | is_numeric(at(words, i - 1))), w).otherwise(F.coalesce(lookup(types, w), w)))

    def full(words, typed):
        return F.transform(typed, lambda w, i: F.when((i > 0) & (w == at(words, i)) & is_street_type(at(typed, i - 1)), F.coalesce(lookup(directions, w), w)).otherwise(w))

    def ordinals(words):  # of each word that a street type follows
        return F.transform(words, lambda w, i: F.when(is_street_type(at(words, i + 1)), lookup(numbers, w).cast("int")))

    def number(words, ordinal, i):
        n = at(ordinal, i)
        n = n + F.when((n < 10) & (i > 0), F.coalesce(lookup(tens, at(words, i - 1)).cast("int"), F.lit(0))).otherwise(0)
        end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
        return F.concat(n.cast("string"), end)

    def written(words, ordinal):
        drop = lambda w, i: lookup(tens, w).isNotNull() & F.coalesce(at(ordinal, i + 1) < 10, F.lit(False))
        return F.transform(words, lambda w, i: F.when(at(ordinal, i).isNotNull(), number(words, ordinal, i)).when(drop(w, i), F.lit(None)).otherwise(w))

    out = let(_words(key), lambda ws: let(typed(ws), lambda ts: let(full(ws, ts), lambda fs: let(ordinals(fs), lambda os: written(fs, os)))))
    return F.array_join(out, " ")


def street_text(key: Column) -> Column:
    """As :func:`expand_abbreviations`, and a direction that ends the street in full, whatever precedes it."""
    last = lambda ws: F.element_at(ws, -1)
    return let(
        _words(expand_abbreviations(key)),
        lambda ws: F.concat_ws(" ", F.slice(ws, F.lit(1), F.size(ws) - 1), F.coalesce(lookup(DIRECTIONS, last(ws)), last(ws))),
    )


def number_terms(number: Column) -> Column:
    """Each value of a list of house numbers ("12;14") as a key of its own."""
    return F.filter(F.transform(F.split(number, ";"), search_key), lambda t: t.isNotNull())


def base_number(number: Column) -> Column:
    """The digits a house number starts with; null without."""
    return F.nullif(F.regexp_extract(number, r"^\s*([0-9]{1,9})", 1), F.lit("")).cast("int")


def flat_number_term(number: Column, unit: Column) -> Column:
    """Unit and number as a slash form writes them; only a unit of one word."""
    u = search_key(unit)
    return F.when(~u.contains(" "), F.concat_ws(" ", u, search_key(number)))


def compact_postcode(postcode: Column) -> Column:
    """The key without blanks."""
    return F.replace(search_key(postcode), F.lit(" "), F.lit(""))


def postcode_forms(postcode: Column) -> Column:
    """The key, and it without blanks where it has any."""
    return F.array_distinct(F.array(search_key(postcode), compact_postcode(postcode)))


def clean_postcode(postcode: Column) -> Column:
    """Upper case, single blanks; null without an ASCII letter or digit."""
    c = F.upper(collapse_whitespace(postcode))
    return F.when(c.rlike("[A-Z0-9]"), c)


def placeholder_postcode(postcode: Column) -> Column:
    """Nothing but zeros."""
    return F.coalesce(compact_postcode(postcode).rlike("^0+$"), F.lit(False))


def unique_words(text: Column) -> Column:
    """Each word once, in order of first use."""
    return F.array_join(F.array_distinct(_words(search_key(text))), " ")


def without_pasted_tags(text: Column) -> Column:
    """What stands before an embedded ``key=value``."""
    return F.trim(F.regexp_replace(text, r"(^|[\s;,]+)[A-Za-z][A-Za-z_:]*=.*$", ""))


def wikidata_item(text: Column) -> Column:
    """42 of "Q42", else null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^[Qq]([0-9]{1,9})$", 1), F.lit("")).cast("int")


def record_id(object_type: Column, object_id: Column) -> Column:
    """``osm:node:1``."""
    return F.concat(F.lit("osm:"), object_type, F.lit(":"), object_id.cast("string"))


def id_number(identifier: Column) -> Column:
    """The number of a well-formed ``osm:<type>:<number>``, else null."""
    return F.nullif(F.regexp_extract(identifier, r"^osm:(?:node|way|relation):([0-9]{1,18})$", 1), F.lit("")).cast("long")


def address_label(number: Column, street: Column, unit: Column, locality: Column, region: Column, country: Column) -> Column:
    """One line of the parts that are there, a unit before the number."""
    first = F.concat_ws(" ", F.when(unit.isNotNull(), F.concat(F.lit("Unit "), unit, F.lit(","))), number, street)
    return F.concat_ws(", ", first, locality, region, country)


def normal_url(url: Column) -> Column:
    """No scheme, no www, no slash at the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?i)(https?://)?(www\.)?", ""), r"/+$", ""))


def last_nine_digits(phone: Column) -> Column:
    """What two spellings of one telephone number share."""
    digits = F.regexp_replace(phone, r"[^0-9]", "")
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9)))


# Road classes from the most to the least important, and kinds of place with their tier.
ROAD_CLASSES = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "pedestrian", "track", "busway",
    "cycleway", "footway", "path", "steps",
]
ALSO_ROADS = {"bridleway": "footway"}
PLACE_TIERS = {
    "country": "country", "state": "region", "province": "region", "region": "region", "county": "district", "district": "district",
    "municipality": "district", "city": "locality", "town": "locality", "village": "locality", "hamlet": "locality", "locality": "locality",
    "suburb": "neighbourhood", "neighbourhood": "neighbourhood", "quarter": "neighbourhood", "borough": "neighbourhood", "island": "place",
    "islet": "place", "farm": "place", "isolated_dwelling": "place",
}


def road_class(highway: Column) -> Column:
    """Rank of a road's class, links like their road; 16 for any other."""
    ranks = {r: str(i) for i, r in enumerate(ROAD_CLASSES)}
    ranks |= {r: ranks[like] for r, like in ALSO_ROADS.items()}
    return F.coalesce(lookup(ranks, F.regexp_replace(highway, "_link$", "")).cast("int"), F.lit(16))


def place_tier(place: Column) -> Column:
    """Tier of a kind of place, else null."""
    return lookup(PLACE_TIERS, F.lower(F.trim(place)))


def licence_terms(text: Column, decided_text: Column | None = None, decided: Column | None = None) -> Column:
    """Restricted, non_commercial or permitted, by the words of a licence; null text is permitted.

    A decision taken by hand holds while the licence still reads as it did then.
    """
    words = F.concat(F.lit(" "), search_key(text), F.lit(" "))
    says = lambda phrases: reduce(or_, [words.contains(f" {p} ") for p in phrases])
    cc = lambda names: [f"{before} {n}" for n in names for before in ("cc", "licenses", "licences")]
    restricted, limited = says(cc(CC_RESTRICTED) + WORDS_RESTRICTED), says(cc(CC_NON_COMMERCIAL) + WORDS_NON_COMMERCIAL)
    ruled = F.when(restricted, "restricted").when(limited, "non_commercial").otherwise("permitted")
    return ruled if decided is None else F.when(F.trim(decided_text) == F.trim(text), decided).otherwise(ruled)
