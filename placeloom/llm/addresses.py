"""Postal addresses in free text: their digit tokens first, then their words, and what the words stand for.

Texts are taken apart by column expressions (``bare_column``, ``numbers_first``). What a word stands for (a street, a
locality, a misspelling of one) is settled once per distinct word of the corpus against a lexicon, itself
taken from the corpus (``lexicon``, ``name_words``), by a join on shared deletions rather than by comparing
all pairs. ``place_words`` then gives each text its rarest street names, their kind and direction, and its localities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.lookalike import folded
from placeloom.runtime import Scratch

# Kinds of street with their usual short forms, directions, words before a unit, endings written onto a name, joining words.
KINDS = [
    ("street", "street st str"), ("avenue", "avenue ave av"), ("road", "road rd"), ("drive", "drive dr drv"), ("crescent", "crescent cres cr"),
    ("terrace", "terrace ter tce"), ("boulevard", "boulevard blvd bvd boul bd"), ("place", "place pl"), ("lane", "lane ln la"), ("court", "court ct crt"),
    ("square", "square sq"), ("close", "close cl"), ("way", "way"), ("rue", "rue r"), ("chemin", "chemin ch che chem"), ("impasse", "impasse imp"),
    ("allee", "allée allee al"), ("calle", "calle c cl"), ("avenue", "avenida av avda avd"), ("plaza", "plaza pl p plz plza pza"), ("paseo", "paseo pso p"),
    ("camino", "camino cno cmno c"), ("strasse", "strasse straße str"), ("gasse", "gasse gss g"), ("weg", "weg wg"), ("platz", "platz pltz plz pl"),
]
DIRECTIONS = [
    ("north", "north n nth"), ("south", "south s sth"), ("east", "east e"), ("west", "west w"), ("upper", "upper upr"), ("lower", "lower lwr"), ("old", "old"),
    ("new", "new"), ("mount", "mount mt"), ("saint", "saint st"),
]
UNITS = ["flat", "unit", "apt", "apartment", "appartement", "appt", "app", "wohnung", "whg", "piso", "puerta", "pta", "porte", "suite", "ste"]
ENDINGS = ["strasse", "gasse", "platz", "allee", "weg", "pltz", "plz", "str", "gss", "wg", "pl", "al", "g"]  # the longest first
LINKS = {"de", "du", "des", "del", "la", "le", "les", "los", "las", "der", "die", "das", "am", "im", "an", "zu", "of", "the", "near", "in", "d", "l"}


def _table(rows: list[tuple[str, str]]) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for kind, forms in rows:
        for f in forms.split():
            out.setdefault(bare(f), set()).add(kind)
    return {k: frozenset(v) for k, v in out.items()}


def bare(text: str) -> str:
    """Look-alikes and case folded, accents dropped."""
    text = folded(text).casefold()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


KIND = _table(KINDS)
DIRECTION = {k: next(iter(v)) for k, v in _table(DIRECTIONS).items()}
_ENDING = re.compile(rf"^([^\W\d_]{{4,}}?)({'|'.join(ENDINGS)})$")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that ``bare`` turns into one other, those others, and letters that it turns into several; by rule."""
    one, other, several = [], [], []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0xFFFE), *range(0x1D400, 0x1D800)]:
        ch = chr(code)
        if unicodedata.category(ch)[0] in "CMZ":
            continue
        to = bare(ch)
        if len(to) == 1 and to != ch:
            one.append(ch)
            other.append(to)
        elif len(to) > 1 and to.isascii() and to != ch and unicodedata.category(ch)[0] == "L":
            several.append((ch, to))
    return "".join(one), "".join(other), several


def bare_column(text: Column) -> Column:
    """As ``bare``, inside the JVM: look-alikes, width and case folded, accents and invisible characters dropped, blanks single."""
    one, other, several = _folds()
    c = F.regexp_replace(F.regexp_replace(text, r"[\p{Z}\s\x00-\x1f\x85]+", " "), r"[\p{Cf}\p{Cc}\ufe00-\ufe0f]+", "")
    c = F.lower(F.translate(c, one, other))
    full = c
    for ch, to in several:
        full = F.replace(full, F.lit(ch), F.lit(to))
    c = F.when(c.rlike("[" + "".join(ch for ch, _ in several) + "]"), full).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\p{M}+", ""), " +", " ")
    plain = F.regexp_replace(F.lower(text), r"[\s\x00-\x1f\x7f]+", " ")
    # most values are plain; only others take the long way
    return F.trim(F.when(text.rlike(r"[^\x20-\x7e]"), c).otherwise(plain))


_CODE = r"(?<![\p{L}\d])([a-z]{1,2}\d[a-z\d]?)\s?(\d[a-z][a-z\d])(?![\p{L}\d])"
_UNIT = rf"(?:(?<![\p{{L}}\d])(?:{'|'.join(UNITS)}|pso)\b\.?\s*(?:#|nr\.?|no\.?)?\s*|#\s*)(\d+\s?[a-z]?)(?![\p{{L}}\d])(?!\s*/)"
_SLASH = r"(?<![\p{L}\d])(\d+)\s*/\s*(\d+)(?:\s?-?\s?([a-z]))?(?![\p{L}\d])"
_DASHED = r"(?<![\p{L}\d])(\d+)\s?-\s?([a-z])(?![\p{L}\d.])"
_APART = r"(?<![\p{L}\d])(\d+) ([abfhijkmoqtuvxyz])(?![\p{L}\d.'])"  # other letters may begin a street's name
_NUMBER = r"(?<![\p{L}\d])(\d+[a-z]?)(?![\p{L}\d])"
_GLUED = rf"(\p{{L}}+)(?:-| -|- )({'|'.join(ENDINGS)})(?![\p{{L}}])\.?"
_WORDS = r"@|\p{L}+(?:'\p{L}+)?\.?|[,;]| - "


def numbers_first(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``numbers, unit, codes, words`` to texts.

    Every digit token stands in one of the first three. ``numbers`` are house numbers with their letter, sorted; ``unit`` follows
    a unit word or sign or stands before a slash. ``codes`` are tokens of letters and digits as postcodes have them, and
    numbers of four digits or more beside a shorter one; of several long ones alone the first is the house number. Any length
    is read. ``words`` keep their order, '@' standing where digits stood and ',' between parts.
    """
    s = F.col("_s")
    step = lambda df, e: df.withColumn("_s", e)
    df = texts.withColumn("_s", F.replace(bare_column(F.col(text_col)), F.lit("’"), F.lit("'")))
    df = step(df, F.regexp_replace(F.regexp_replace(s, r"(?<![\p{L}\d])c/\s*", "calle "), _GLUED, "$1$2."))
    code = F.concat(F.regexp_extract(s, _CODE, 1), F.regexp_extract(s, _CODE, 2))
    df = step(df.withColumn("_code", code), F.regexp_replace(s, _CODE, " , "))
    df = df.withColumn("unit", F.replace(F.regexp_extract(s, _UNIT, 1), F.lit(" "), F.lit("")))
    df = step(df, F.regexp_replace(s, _UNIT, " , "))
    df = df.withColumn("unit", F.when(F.col("unit") == "", F.regexp_extract(s, _SLASH, 1)).otherwise(F.col("unit")))
    df = step(df, F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _SLASH, "$2$3"), _DASHED, "$1$2"), _APART, "$1$2"))
    plain = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    df = df.withColumn("_n", F.regexp_extract_all(s, F.lit(_NUMBER), F.lit(1)))
    long = lambda x: x.rlike(r"^\d{4,}$")
    df = df.withColumn("_short", F.filter("_n", lambda x: ~long(x))).withColumn("_long", F.filter("_n", long))
    numbers = F.when(F.size("_short") > 0, F.col("_short")).otherwise(F.slice("_long", 1, 1))
    others = F.when(F.size("_short") > 0, F.col("_long")).otherwise(F.slice("_long", F.lit(2), F.greatest(F.size("_long") - 1, F.lit(0))))
    codes = F.array_distinct(F.concat(F.filter(F.array("_code"), lambda x: x != ""), others))
    words = F.transform(F.regexp_extract_all(F.regexp_replace(s, _NUMBER, " @ "), F.lit(_WORDS), F.lit(0)), lambda w: F.when(w.isin(",", ";", " - "), ",").otherwise(w))
    return df.select(
        *texts.columns, F.array_sort(F.array_distinct(F.transform(numbers, plain))).alias("numbers"), plain(F.col("unit")).alias("unit"), codes.alias("codes"), words.alias("words")
    )


def street_words(text: Column) -> Column:
    """The words of a column that holds a street or a locality alone, in order, without separators."""
    s = F.regexp_replace(F.regexp_replace(F.replace(bare_column(text), F.lit("’"), F.lit("'")), r"(?<![\p{L}\d])c/\s*", "calle "), _GLUED, "$1$2.")
    return F.filter(F.coalesce(F.regexp_extract_all(s, F.lit(_WORDS), F.lit(0)), F.expr("cast(array() as array<string>)")), lambda w: w.rlike(r"^\p{L}"))


def name_column(word: Column) -> Column:
    """``is_name`` inside the JVM, of a word without its dot."""
    return (F.length(word) >= 3) & ~word.isin([w for w in sorted({*KIND, *DIRECTION, *LINKS, *UNITS}) if len(w) >= 3])


def tokens(s: str) -> list[str]:
    """Words in order; '@' where the number stood, ',' between parts, a dot kept on what it shortens."""
    out: list[str] = []
    for t in re.findall(r"@|[^\W\d_]+(?:'[^\W\d_]+)?\.?|[,;\n]|\s-\s|-", s):
        if t in ",;\n" or t == " - ":
            out.append(",")
        elif t == "-":
            out.append("-")
        else:
            out.append(t)
    joined: list[str] = []
    for i, t in enumerate(out):
        # "kigepomond-g." and "gudafucombe weg": an ending apart belongs to the word before it
        if t == "-":
            continue
        if i and joined and out[i - 1] == "-" and joined[-1].isalpha() and t.rstrip(".") in ENDINGS:
            joined[-1] = joined[-1] + t.rstrip(".") + "."
        else:
            joined.append(t)
    return joined


def spell(word: str) -> list[tuple[str, str]]:
    """Ways to take a word: ``(name, kind)``, whole first, then without a kind of street written onto it."""
    dotted, word = word.endswith("."), word.rstrip(".")
    out = [(word, "")]
    m = _ENDING.match(word)
    while m:
        name, end = m[1], m[2]
        kinds = KIND[end] & {"strasse", "gasse", "weg", "platz", "allee"}
        if len(end) > 1 or dotted:
            out.append((name, next(iter(kinds))))
        break
    if not m or len(m[2]) > 1 or dotted:
        return out
    return [*out, (m[1], "gasse")]


def is_name(word: str) -> bool:
    w = word.rstrip(".")
    return len(w) >= 3 and w not in KIND and w not in DIRECTION and w not in LINKS and w not in UNITS


def lexicon(streets: DataFrame, localities: DataFrame, scratch: Scratch) -> DataFrame:
    """``(spelling, name, kind, role, n)`` of names in street and locality columns.

    ``streets(text, number)``, ``localities(text)``; ``n`` counts the distinct house numbers that a street's
    spelling comes with (a misspelling hardly comes with several) or the rows of a locality.
    """

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, role in zip(frame["text"], frame["role"]):
                words = [w for w in tokens(bare(text)) if is_name(w)]
                if role == "locality":
                    out += [(text, role, w.rstrip("."), w.rstrip("."), "") for w in words]
                    continue
                given = any(w.rstrip(".") in KIND for w in tokens(bare(text)))
                for w in words:
                    name, kind = (w.rstrip("."), "") if given else spell(w)[-1]
                    out.append((text, role, w.rstrip("."), name, kind))
                    if name != w.rstrip("."):
                        out.append((text, role, name, name, ""))
            yield pd.DataFrame(out, columns=["text", "role", "spelling", "name", "kind"]).drop_duplicates()

    st = streets.filter("text is not null").select("text", F.coalesce(F.col("number").cast("string"), F.lit("")).alias("number"), F.lit("street").alias("role")).distinct()
    lo = localities.filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("locality"))
    st, lo = scratch.write(st), scratch.write(lo)
    texts = st.select("text", "role").distinct().unionByName(lo.select("text", "role"))
    taken = scratch.write(texts.mapInPandas(take, "text string, role string, spelling string, name string, kind string"))
    of = ["spelling", "name", "kind", "role"]
    by_street = taken.join(st, ["text", "role"]).select(*of, "number").distinct().groupBy(*of).agg(F.count(F.lit(1)).alias("n"))
    by_place = taken.join(lo, ["text", "role"]).groupBy(*of).agg(F.sum("n").alias("n"))
    counted = by_street.unionByName(by_place)
    best = counted.groupBy("spelling").agg(F.max(F.struct(F.col("n"), (F.col("kind") != "").alias("c"), "name", "kind", "role")).alias("b"), F.sum("n").alias("n"))
    # a rare spelling with its kind written onto it is taken apart instead, so that its name can be mended
    return scratch.write(best.select("spelling", "b.name", "b.kind", "b.role", "n").filter("name = spelling or n > 2"))


def _deletions(word) -> F.Column:
    """A word and what is left of it without any one of its letters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def name_words(words: DataFrame, lex: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, name, kind, role, n)`` for the distinct ``words(word)``.

    A word found in the lexicon is that, unless it is rare there and one letter (or a swap of two) away from a
    spelling more than twice as common; one not found is the commonest spelling so near, whole or without an
    ending; a word near nothing is its own name, with no role.
    """

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(w, i, s, k) for w in frame["word"] for i, (s, k) in enumerate(spell(w))]
            yield pd.DataFrame(out, columns=["word", "rank", "spelling", "ending"])

    distinct = words.select("word").filter("word is not null").distinct()
    taken = scratch.write(distinct.mapInPandas(ways, "word string, rank int, spelling string, ending string"))
    spellings = taken.select("spelling").distinct().join(lex.select("spelling", F.col("n").alias("own")), "spelling", "left")
    probe = spellings.filter(F.length("spelling") >= 5).select("spelling", F.coalesce("own", F.lit(0)).alias("own"), F.explode(_deletions(F.col("spelling"))).alias("gap"))
    target = lex.filter("length(spelling) >= 5 and n >= 2").select(F.col("spelling").alias("to"), F.col("n").alias("n_to"), F.explode(_deletions(F.col("spelling"))).alias("gap"))
    near = probe.join(target.hint("merge"), "gap").filter("to != spelling and n_to >= 2 * own + 1 and own <= 3 and levenshtein(spelling, to) <= 2")
    fixed = near.groupBy("spelling").agg(F.max(F.struct((-F.levenshtein("spelling", "to")).alias("d"), "n_to", "to")).alias("fix"))
    known = spellings.join(fixed, "spelling", "left").select("spelling", F.coalesce("fix.to", F.when(F.col("own").isNotNull(), F.col("spelling"))).alias("as"), F.col("fix").isNotNull().alias("mended"))
    full = known.filter("`as` is not null").join(lex.withColumnRenamed("spelling", "as"), "as")
    every = taken.join(full, "spelling", "left").withColumn("kind", F.when(F.col("ending") != "", F.col("ending")).otherwise(F.col("kind")))
    # exact before mended, whole before cut
    order = F.struct(F.when(F.col("name").isNull(), 2).when(F.col("mended"), 1).otherwise(0).alias("o"), F.col("rank"))
    best = every.groupBy("word").agg(F.min(F.struct(order.alias("o"), "spelling", "name", "kind", "ending", "role", "n")).alias("b"))
    return scratch.write(
        best.select(
            "word", F.coalesce("b.name", "b.spelling").alias("name"), F.coalesce("b.kind", "b.ending", F.lit("")).alias("kind"),
            F.coalesce("b.role", F.lit("")).alias("role"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n"),
        )
    )


def _lookup(table: dict, word: Column) -> Column:
    values = lambda v: F.array(*map(F.lit, sorted(v))) if isinstance(v, frozenset) else F.lit(v)
    return F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), values(v))]), word)


def place_words(parsed: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``street, second, kinds, directions, localities, others`` of rows with ``words``; rows without a name are left out.

    ``street`` is the rarest name that is not a locality's (by the rows that hold it; names of the street column before unknown ones),
    ``second`` the next rarest or ''; ``others`` are the names of the street column but the first. ``kinds`` and ``directions`` are those of the words around
    the street, as far as the next name or separator.

    Only names meet the lexicon, not the separators, kinds and short words that nearly every row holds; a row's words ride along with its
    first name. A name in a third of all rows meets one row of ``named``: AQE splits its key.
    """
    word = lambda c: F.regexp_replace(c, r"\.$", "")
    first_at = F.array_min(F.filter(F.transform("words", lambda w, i: F.when(name_column(word(w)), i)), lambda x: x.isNotNull()))
    spread = parsed.select(*keys, "words", first_at.alias("_f")).filter("_f is not null").select(*keys, "words", "_f", F.posexplode("words").alias("at", "word"))
    spread = spread.filter(name_column(word(F.col("word")))).withColumn("words", F.when(F.col("at") == F.col("_f"), F.col("words")))
    met = spread.join(named, "word", "left")
    met = met.select(*keys, "at", "words", F.coalesce("name", word(F.col("word"))).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("df", F.lit(0)).cast("long").alias("df"))
    rank = F.when(F.col("role") == "street", 0).when(F.col("role") == "", 1).otherwise(2)
    rows = met.groupBy(*keys).agg(F.max("words").alias("words"), F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "df", "at", "name", "kind", "role"))).alias("names"))
    first = F.get("names", F.lit(0))
    rows = rows.withColumn("_first", first).withColumn("_at", first["at"])
    rows = rows.withColumn("_own", F.filter("names", lambda x: (x["rank"] <= 1) & (x["at"] != F.col("_at"))))
    stops = F.concat(F.transform("names", lambda x: x["at"]), F.filter(F.transform("words", lambda w, i: F.when(w.isin("@", ","), i)), lambda x: x.isNotNull()))
    rows = rows.withColumn("_stops", stops)
    low = F.coalesce(F.array_max(F.filter("_stops", lambda x: x < F.col("_at"))), F.lit(-1))
    high = F.coalesce(F.array_min(F.filter("_stops", lambda x: x > F.col("_at"))), F.size("words"))
    rows = rows.withColumn("_ahead", F.transform(F.slice("words", low + 2, F.col("_at") - low - 1), word)).withColumn("_after", F.transform(F.slice("words", F.col("_at") + 2, high - F.col("_at") - 1), word))
    kind, direction = (lambda w: _lookup(KIND, w)), (lambda w: _lookup(DIRECTION, w))
    typed = F.exists(F.concat("_ahead", "_after"), lambda w: kind(w).isNotNull() & direction(w).isNull())
    rows = rows.withColumn("_typed", typed)
    # "st" ahead of a name is Saint; behind it, it is a street unless another kind is there
    saint = lambda w, ahead: F.when((w == "st") & (F.lit(not ahead) & ~F.col("_typed")), F.lit(None)).otherwise(direction(w))
    known = lambda a: F.filter(a, lambda x: x.isNotNull())
    directions = F.concat(known(F.transform("_ahead", lambda w: saint(w, True))), known(F.transform("_after", lambda w: saint(w, False))))
    sets = F.concat(known(F.transform("_ahead", lambda w: F.when(direction(w).isNull(), kind(w)))), known(F.transform("_after", lambda w: F.when(saint(w, False).isNull(), kind(w)))))
    narrowed = F.aggregate(sets, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(F.size(acc) == 0, x).when(F.size(F.array_intersect(acc, x)) > 0, F.array_intersect(acc, x)).otherwise(acc))
    return rows.select(
        *keys, F.col("_first.name").alias("street"), F.coalesce(F.get("_own", F.lit(0))["name"], F.lit("")).alias("second"),
        F.when(F.col("_first.kind") != "", F.array("_first.kind")).otherwise(F.array_sort(narrowed)).alias("kinds"), F.array_join(F.array_sort(F.array_distinct(directions)), " ").alias("directions"),
        F.array_sort(F.array_distinct(F.transform(F.filter("names", lambda x: (x["role"] == "locality") & (x["at"] != F.col("_at"))), lambda x: x["name"]))).alias("localities"),
        F.array_sort(F.array_distinct(F.transform(F.filter("_own", lambda x: x["role"] == "street"), lambda x: x["name"]))).alias("others"),
    )


def settle_words(parsed: DataFrame, keys: list[str], lex: DataFrame, scratch: Scratch) -> DataFrame:
    """``place_words`` of rows with ``words``, their names looked up in ``lex`` and counted among these rows."""
    plain = F.regexp_replace("word", r"\.$", "")
    counted = scratch.write(parsed.select(F.explode(F.array_distinct("words")).alias("word")).filter(name_column(plain)).groupBy("word").agg(F.count(F.lit(1)).alias("c")))
    named = name_words(counted, lex, scratch)
    df = named.join(counted, "word").groupBy("name").agg(F.sum("c").alias("df"))
    return place_words(parsed, scratch.write(named.join(df, "name", "left")), keys)
