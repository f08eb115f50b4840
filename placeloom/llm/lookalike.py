"""One consistent form for texts that look the same but differ in their characters.

Distinct tokens of the corpus go, by the hash of a coarse key, into shards of bounded size. In each shard the clean
spellings make up a trie; every other token, as it stands, is run against it by a weighted edit automaton: a
look-alike letter, another width or composition of one, and an inserted character that shows nothing cost nothing, a look-alike
of another group of shapes little, all else more than allowed. Of the spellings so reached the cheapest and
then the commonest becomes the token's form; tokens that reach none are normalised character by character by the table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.runtime import Scratch

# Letters that are drawn like a Latin letter, which stands before them.
TWINS = [
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟⅭ", "DᎠⅮ", "EЕΕᎬ", "FϜ", "GԌᏀ", "HНΗᎻ", "IІΙᏆ", "JЈͿᎫ", "KКΚᏦ", "LᏞⅬ", "MМΜᎷⅯ", "NΝ", "OОΟՕ", "PРΡᏢ", "QԚ", "RᎡ", "SЅՏᏚ", "TТΤᎢ", "UՍ",
    "VѴᏙⅤ", "WԜᎳ", "XХΧⅩ", "YУΥҮ", "ZΖᏃ",
    "aаɑ", "cсϲⅽᴄ", "dԁⅾ", "eе", "gɡց", "hһհ", "iі", "jјϳ", "mⅿ", "nո", "oоοօᴏ", "pрρ", "qԛզ", "sѕꜱ", "uս", "vѵνⅴᴠ", "wԝաᴡ", "xхⅹ", "yу", "zᴢ", "-‐‑",
]
TWIN = {c: group[0] for group in TWINS for c in group[1:]}
# Signs drawn like more than one Latin letter, the likelier first.
SEVERAL = {"Ӏ": "Il", "ӏ": "lI", "Ⅰ": "Il", "ⅼ": "lI", "Ɩ": "lI", "υ": "uv", "ʋ": "vu", "ү": "yv"}
TWIN |= {c: letters[0] for c, letters in SEVERAL.items()}
#: Cost of a letter's less likely reading, and what may be spent on a token; any other edit would cost more than that.
SECOND, BUDGET = 1, 2
#: Tokens of a shard, about.
SHARD_TOKENS = 50_000


@lru_cache(maxsize=100_000)
def _unfold(ch: str) -> str:
    """What one character shows: nothing if invisible, a blank, or its letter at usual width, decomposed."""
    kind = unicodedata.category(ch)
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return " "
    if kind in ("Cf", "Cc") or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤ":
        return ""
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")) or (tag.startswith("<compat>") and kind[0] == "L"):
        return unicodedata.normalize("NFKD", ch)
    return ch


def shown(text: str) -> str:
    """Width and invisible characters removed, canonical composition, single blanks."""
    if text.isascii() and text.isprintable():
        return " ".join(text.split())
    return unicodedata.normalize("NFC", " ".join("".join(map(_unfold, text)).split()))


def folded(text: str) -> str:
    """The table's form: as shown, with look-alike letters replaced by the Latin ones."""
    text = shown(text)
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(TWIN.get(c, c) for c in unicodedata.normalize("NFD", text)))


def _classes() -> dict[str, str]:
    """Letters that one sign may stand for share a class: a key that no look-alike can change."""
    of: dict[str, str] = {}
    for letters in SEVERAL.values():
        joined = {of.get(x, x) for x in letters}
        for x in [*of, *letters]:
            if of.get(x, x) in joined:
                of[x] = min(joined)
    return of


_CLASS = str.maketrans(_classes())


def coarse(text: str) -> str:
    """Equal for all tokens that the automaton can bring together."""
    return folded(text).translate(_CLASS)


def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0] if unicodedata.category(ch)[0] == "L" else ""


def clean(token: str) -> bool:
    """Whether a token may be a canonical spelling: of usual width, nothing invisible, letters of one script."""
    return token.isascii() or (token == shown(token) and len({_script(c) for c in token} - {""}) <= 1)


@lru_cache(maxsize=100_000)
def _readings(ch: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """What one character of a token may be read as: a sequence, each place with its letters and their cost; empty if it shows nothing."""
    return tuple(tuple((SECOND * i, x) for i, x in enumerate(SEVERAL.get(c) or (TWIN.get(c, c),))) for c in unicodedata.normalize("NFD", _unfold(ch)))


class Trie:
    """Clean spellings, decomposed, with their weight; ``near`` runs a token against them."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.drawn: dict[str, set[str]] = {}

    def add(self, token: str, weight: tuple) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", token):
            self.drawn.setdefault(TWIN.get(ch, ch), set()).add(ch)
            node = node.setdefault(ch, {})
        node[""] = (weight, token)

    def near(self, token: str, budget: int = BUDGET) -> list[tuple[int, tuple, str]]:
        """(cost, weight, spelling) of all spellings that a token, as it stands, may be read as within ``budget``.

        Zero-cost edges skip characters that show nothing, take another width or composition apart, and cross from a letter to any that
        is drawn like it; a sign with several readings pays for the less likely ones.
        """
        states: dict[int, tuple[int, dict]] = {id(self.root): (0, self.root)}
        for ch in unicodedata.normalize("NFD", token):
            for readings in _readings(ch):
                ahead: dict[int, tuple[int, dict]] = {}
                for cost, node in states.values():
                    for more, letter in readings:
                        if cost + more <= budget:
                            for drawn in self.drawn.get(letter, ()):
                                below = node.get(drawn)
                                if below is not None and ahead.get(id(below), (budget + 1,))[0] > cost + more:
                                    ahead[id(below)] = (cost + more, below)
                states = ahead
                if not states:
                    return []
        return [(cost, *node[""]) for cost, node in states.values() if "" in node]


def spellings(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """``(token, form)`` of the distinct tokens whose form differs, from ``tokens(token)`` with repeats."""
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(fold=frame["token"].map(folded), key=frame["token"].map(coarse))

    counted = scratch.write(counted.mapInPandas(fold, "token string, n long, fold string, key string"))
    shards = counted.count() // SHARD_TOKENS + 1

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for token, n in zip(frame["token"], frame["n"]):
            if clean(token):
                trie.add(token, (token.isascii(), n))
        out = []
        for token, fold in zip(frame["token"], frame["fold"]):
            if token.isascii() and token.isprintable():
                continue  # a plain spelling is its own form
            reached = trie.near(token)
            best = max(reached, key=lambda x: (-x[0], x[1], x[2]))[2] if reached else fold
            if best != token:
                out.append((token, best))
        return pd.DataFrame(out, columns=["token", "form"])

    out = counted.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(choose, "token string, form string")
    return scratch.write(out)


def consistent_forms(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(text, form)``: every distinct non-null text and its consistent form, equal for all that look the same.

    Blanks become single spaces, none at either end; a text of nothing visible has the form ''. Case,
    accents, punctuation and spelling stay. Other columns are not read; an empty table gives no rows.
    Only texts with other than printable ASCII characters are taken apart into tokens for the look-up,
    but all tokens are in the vocabulary. A token in a third of all texts meets one row of the map.
    """
    scratch = Scratch(texts.sparkSession, "lookalike")
    distinct = scratch.write(texts.select(F.col(text_col).alias("text")).filter("text is not null").distinct())
    blanks = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
    words = F.filter(F.split("text", blanks), lambda x: x != "")
    plain = ~F.col("text").rlike(r"[^\x20-\x7e]")
    forms = spellings(distinct.select(F.explode(words).alias("token")), scratch)
    odd = distinct.filter(~plain).select("text", F.posexplode(words).alias("at", "token"))
    joined = odd.join(forms, "token", "left").groupBy("text").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("form", "token").alias("form")))).alias("parts")
    )
    joined = distinct.filter(~plain).join(joined, "text", "left").select("text", F.coalesce(F.array_join(F.filter("parts.form", lambda x: x != ""), " "), F.lit("")).alias("form"))
    simple = distinct.filter(plain).select("text", F.trim(F.regexp_replace("text", " +", " ")).alias("form"))
    return simple.unionByName(joined)


def alike_pairs(values: DataFrame, group_col: str, key_col: str, text_col: str, ignore: list[str] | None = None) -> DataFrame:
    """``(group, key_a, key_b)``: keys of a group whose texts look the same but are not the same code points.

    ``key_a < key_b``; null texts, keys and groups pair with nothing, nor do texts that show nothing or
    whose form is one of ``ignore``.
    Work follows the pairs there are: distinct spellings meet first, their keys after, so that a text
    repeated in a third of all rows costs nothing unless another spelling of it exists.
    """
    scratch = Scratch(values.sparkSession, "lookalike")
    rows = values.select(F.col(group_col).alias("g"), F.col(key_col).alias("k"), F.col(text_col).alias("text"))
    rows = scratch.write(rows.filter("g is not null and k is not null and text is not null").distinct())
    forms = scratch.write(consistent_forms(rows, "text").filter(~F.col("form").isin(["", *(ignore or [])])))
    kinds = scratch.write(rows.select("g", "text").distinct().join(forms, "text"))
    many = kinds.groupBy("g", "form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kinds = kinds.join(many, ["g", "form"], "left_semi")
    met = kinds.select("g", "form", F.col("text").alias("ta")).join(kinds.select("g", "form", F.col("text").alias("tb")), ["g", "form"]).filter("ta != tb")
    a = rows.select("g", F.col("text").alias("ta"), F.col("k").alias("key_a"))
    b = rows.select("g", F.col("text").alias("tb"), F.col("k").alias("key_b"))
    pairs = met.join(a, ["g", "ta"]).join(b, ["g", "tb"]).filter("key_a < key_b")
    return pairs.select(F.col("g").alias(group_col), "key_a", "key_b").distinct()
