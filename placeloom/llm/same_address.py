"""Texts that denote the same postal address, however written: numbers first.

Every text is its sorted digit tokens (house numbers with letter, units marked as such) and words. Texts meet in blocks of
those tokens, one rare word, the rarest that is not a locality's, and a place they share. What remains of them is then
compared by set operations: the rarity-weighted share of what both state, with the levenshtein distance of words left
unmatched. All of it is column expressions and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm import addresses
from placeloom.runtime import Scratch

SIGN = ["digits", "street", "second", "kinds", "directions", "codes", "localities", "others"]


def read_texts(texts: DataFrame, text_col: str, streets: DataFrame, localities: DataFrame, codes: DataFrame, scratch: Scratch) -> DataFrame:
    """``text`` and ``SIGN``, one row a distinct text that has a house number and a name.

    The sole long number of a text is its house number unless ``codes(text)`` or texts with a house number beside it know it as a postcode.
    """
    distinct = texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    # written before it is filtered: a filter pushed below would take every text apart twice
    parsed = scratch.write(addresses.numbers_first(scratch.write(distinct))).filter("size(numbers) > 0")
    sole = (F.size("numbers") == 1) & F.get("numbers", F.lit(0)).rlike(r"^\d{4,}$") & (F.size("codes") == 0)
    stated = codes.select(F.regexp_replace(F.lower("text"), r"[^a-z0-9]", "").alias("code"))
    known = stated.unionByName(parsed.select(F.explode("codes").alias("code"))).filter(F.col("code").rlike(r"^\d{4,}$")).distinct()
    alone = parsed.filter(sole).withColumn("code", F.get("numbers", F.lit(0))).join(known, "code", "left_anti").drop("code")
    kept = scratch.write(parsed.filter(~sole).unionByName(alone))
    lex = addresses.lexicon(streets, localities, scratch)
    settled = addresses.settle_words(kept, ["text"], lex, scratch)
    unit = F.when(F.col("unit") != "", F.array(F.concat(F.lit("u"), "unit"))).otherwise(F.expr("cast(array() as array<string>)"))
    digits = F.array_join(F.concat("numbers", unit), " ")
    return scratch.write(kept.select("text", digits.alias("digits"), F.array_sort("codes").alias("codes")).join(settled, "text"))


def _rarity(read: DataFrame, values: Column) -> DataFrame:
    """``(value, w)``: ln((1 + all) / those that state it)."""
    total = read.agg(F.count(F.lit(1)).alias("_all"))
    counted = read.select(F.explode(values).alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    return counted.crossJoin(F.broadcast(total)).select("value", F.log((F.col("_all") + 1) / F.col("_n")).alias("w"))


def same_address_pairs(
    texts: DataFrame, streets: DataFrame, localities: DataFrame, key_col: str = "key", text_col: str = "text", accept: float = 0.8, codes: DataFrame | None = None,
) -> DataFrame:
    """``(key_a, key_b)`` of texts that denote one address, to the house number, letter and unit; ``key_a < key_b``.

    ``streets(text, number)`` and ``localities(text)`` are columns of names the lexicon is taken from, ``codes(text)`` one of
    postcodes; any may be empty. Null and blank texts, null keys and texts without a house number or name pair with
    nothing; equal texts of different keys pair; repeated rows count once. Texts are read whole, numbers at any length.

    A pair must agree on its digit tokens, directions and, where both state one, kind of street; words left unmatched on both sides
    must be within two letters; and of the rarity of what both state, 0.8 must agree. A text that leaves its kind
    or place open pairs with those that state one only while all it could pair with agree on it.

    Distinct addresses as written are compared, not rows, so a text repeated in a third of all rows is one of them; rows
    come in only as pairs are written out. Blocks hold one house number of one street name in one place (a stated locality,
    or that of a stated postcode), so that a name found in every town doesn't bring its towns together; only
    texts that state no place meet all of a name's.
    """
    scratch = Scratch(texts.sparkSession, "same-address")
    codes = texts.sparkSession.createDataFrame([], "text string") if codes is None else codes
    rows = texts.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).filter("key is not null and text is not null").distinct()
    read = read_texts(rows, "text", streets, localities, codes, scratch).withColumn("sign", F.xxhash64(*SIGN))
    keys = scratch.write(rows.join(read.select("text", "sign"), "text").select("key", "sign").distinct())
    # where a postcode lies, by the texts that state a locality with it
    where = read.select(F.explode("codes").alias("code"), "localities").select("code", F.explode("localities").alias("locality"))
    where = where.groupBy("code", "locality").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.max_by("locality", F.struct("n", "locality")).alias("at"))
    weights = scratch.write(_rarity(read, F.concat(F.array("street"), "localities", "codes")))
    signs = read.dropDuplicates(["sign"]).select("sign", *SIGN)
    marks = signs.select("sign", F.explode(F.concat(F.array(F.concat(F.lit("s:"), "street")), F.transform("localities", lambda x: F.concat(F.lit("l:"), x)), F.transform("codes", lambda x: F.concat(F.lit("c:"), x)))).alias("mark"))
    marks = marks.withColumn("value", F.substring("mark", F.lit(3), F.length("mark"))).join(weights, "value").join(where.withColumnRenamed("code", "value"), "value", "left")
    most = lambda tag: F.coalesce(F.max(F.when(F.col("mark").startswith(tag), F.col("w"))), F.lit(0.0))
    weighed = marks.groupBy("sign").agg(
        most("s:").alias("w_street"), most("l:").alias("w_locality"), most("c:").alias("w_code"),
        F.array_sort(F.collect_set(F.when(F.col("mark").startswith("l:"), F.col("value")).when(F.col("mark").startswith("c:"), F.col("at")))).alias("places"),
    )
    signs = scratch.write(signs.join(weighed, "sign"))

    rare = F.explode(F.array_distinct(F.filter(F.array("street", "second"), lambda x: x != ""))).alias("rare")
    slim = ["sign", "kinds", "directions", "codes", "localities", "street", "others", "w_street", "w_locality", "w_code"]
    blocks = signs.select("digits", rare, "places", *slim)
    side = lambda df, x: df.select("digits", "rare", *([F.explode("places").alias("place")] if x[1] == "p" else []), *[F.col(c).alias(f"{c}_{x[0]}") for c in slim])
    bare, placed = blocks.filter("size(places) = 0"), blocks.filter("size(places) > 0")
    both = lambda c: (F.size(f"{c}_a") > 0) & (F.size(f"{c}_b") > 0)
    agree = lambda c: F.arrays_overlap(f"{c}_a", f"{c}_b")
    left = lambda x, y: F.array_except(F.concat(F.array(f"street_{x}"), f"others_{x}"), F.concat(F.array(f"street_{y}"), f"others_{y}"))
    near = F.forall(left("a", "b"), lambda p: F.exists(left("b", "a"), lambda q: F.levenshtein(p, q) <= 2)) | F.forall(left("b", "a"), lambda p: F.exists(left("a", "b"), lambda q: F.levenshtein(p, q) <= 2))
    town = agree("localities") | F.exists("localities_a", lambda p: F.exists("localities_b", lambda q: F.levenshtein(p, q) <= 2))
    weight = lambda c, known, same: (F.when(known & same, F.greatest(f"{c}_a", f"{c}_b")).otherwise(0.0), F.when(known, F.greatest(f"{c}_a", f"{c}_b")).otherwise(0.0))
    got_l, of_l = weight("w_locality", both("localities"), town)
    got_c, of_c = weight("w_code", both("codes"), agree("codes"))
    w_street = F.least("w_street_a", "w_street_b")
    good = (
        (F.col("sign_a") != F.col("sign_b")) & (F.col("directions_a") == F.col("directions_b")) & (~both("kinds") | agree("kinds")) & near
        & ((w_street + got_l + got_c) / (w_street + of_l + of_c) >= accept)
    )
    out = ["sign_a", "sign_b", "kinds_a", "kinds_b", "codes_a", "codes_b", "localities_a", "localities_b"]
    met = side(placed, "ap").join(side(placed, "bp"), ["digits", "rare", "place"]).filter(good).select(*out)
    lone = side(bare, "a ").join(side(blocks, "b "), ["digits", "rare"]).filter(good).select(*out)
    back = side(placed, "a ").join(side(bare, "b "), ["digits", "rare"]).filter(good).select(*out)
    met = scratch.write(met.unionByName(lone).unionByName(back).dropDuplicates(["sign_a", "sign_b"]))
    # what the partners of a sign say that it leaves open itself
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    seen = met.groupBy("sign_a").agg(
        F.countDistinct(one("codes_b")).alias("codes"), F.countDistinct(F.when(F.size("codes_b") == 0, one("localities_b"))).alias("towns"), F.countDistinct(one("kinds_b")).alias("n_kinds"),
    )
    open_ = seen.filter("codes > 1 or n_kinds > 1 or (codes = 0 and towns > 1)").select(F.col("sign_a").alias("sign"), "n_kinds")
    for x, y in (("a", "b"), ("b", "a")):
        none = (F.size(f"codes_{x}") == 0) & (F.size(f"localities_{x}") == 0) & (F.size(f"codes_{y}") + F.size(f"localities_{y}") > 0)
        vague = open_.select(F.col("sign").alias(f"sign_{x}"), "n_kinds")
        met = met.join(vague, f"sign_{x}", "left").filter(F.col("n_kinds").isNull() | ~(none | ((F.size(f"kinds_{x}") == 0) & (F.size(f"kinds_{y}") > 0) & (F.col("n_kinds") > 1)))).drop("n_kinds")
    met = met.select("sign_a", "sign_b").unionByName(signs.select(F.col("sign").alias("sign_a"), F.col("sign").alias("sign_b")))
    ka, kb = keys.select(F.col("key").alias("key_a"), F.col("sign").alias("sign_a")), keys.select(F.col("key").alias("key_b"), F.col("sign").alias("sign_b"))
    return met.join(ka, "sign_a").join(kb, "sign_b").filter("key_a < key_b").select("key_a", "key_b").distinct()
