"""Records of one thing in several sources that share no identifier: a label model over votes.

Candidates share house number, unit, street name and some evidence of place. Matching functions
vote on each (agree, differ, no opinion). A generative model of the votes, fitted by expectation
maximisation to the counts of vote patterns, learns how often each function is right among
matches and others; functions correlated beyond that are modelled jointly, up to three together. It gives
each candidate the posterior probability of being a match.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm import addresses
from placeloom.operators.proximity import distance_m, is_point
from placeloom.runtime import Scratch

VOTES = ["v_locality", "v_postcode", "v_distance", "v_kind", "v_direction", "v_spelling", "v_region"]
#: Functions whose "differ" a match hardly ever gets: another kind of street or direction is another street.
VETOES = ["v_kind", "v_direction"]
RARELY = 1e-6
CELL_DEG = 0.01  # about 1.1 km of latitude


class LabelModel:
    """Two latent classes; each factor (a vote, or up to ``most`` correlated ones) independent given the class.

    ``vetoes`` are positions of votes whose -1 has the probability ``RARELY`` among matches; that alone is given, all else learned.
    """

    def __init__(self, rounds: int = 200, smooth: float = 0.1, vetoes: tuple[int, ...] = (), most: int = 3):
        self.rounds, self.smooth, self.vetoes, self.most = rounds, smooth, vetoes, most

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """``patterns``: distinct vote rows in -1, 0, 1; ``counts``: how often each occurs."""
        self.factors = [[i] for i in range(patterns.shape[1])]
        pairs = self._correlated(patterns, counts)
        self.joined = pairs[0] if pairs else None
        varied = lambda f: any(len(set(patterns[:, v])) > 1 for v in f)
        for i, j in pairs:
            if sum(map(varied, self.factors)) <= 3:
                break  # two classes cannot be told from fewer independent views
            a, b = (next(f for f in self.factors if v in f) for v in (i, j))
            if a is not b and len(a) + len(b) <= self.most:
                self.factors = [f for f in self.factors if f is not a and f is not b] + [a + b]
        self._em(patterns, counts)
        return self

    def _codes(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [sum((patterns[:, v] + 1) * 3**k for k, v in enumerate(f)).astype(int) for f in self.factors]

    def _em(self, patterns: np.ndarray, counts: np.ndarray) -> None:
        codes = self._codes(patterns)
        # start from the balance of the votes
        post = 1 / (1 + np.exp(-2.0 * (patterns.sum(1) - 1)))
        for _ in range(self.rounds):
            w = np.stack([counts * (1 - post), counts * post])
            self.prior = (w.sum(1) + self.smooth) / (w.sum() + 2 * self.smooth)
            self.tables = []
            for f, c in zip(self.factors, codes):
                t = np.stack([np.bincount(c, w[k], 3 ** len(f)) for k in (0, 1)]) + 3 * self.smooth / 3 ** len(f)  # as much in all for joined votes
                t /= t.sum(1, keepdims=True)
                for k, v in enumerate(f):
                    if v in self.vetoes:
                        differ = np.arange(3 ** len(f)) // 3**k % 3 == 0
                        t[1, differ] *= RARELY / t[1, differ].sum()
                        t[1, ~differ] *= (1 - RARELY) / t[1, ~differ].sum()
                self.tables.append(np.log(t))
            new = self._posterior(codes)
            moved, post = np.abs(new - post).max(initial=0), new
            if moved < 1e-6:
                break

    def _posterior(self, codes: list[np.ndarray]) -> np.ndarray:
        ll = np.log(self.prior)[:, None] + sum(t[:, c] for t, c in zip(self.tables, codes))
        return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -700, 700)))

    def predict(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(self._codes(patterns))

    @staticmethod
    def _correlated(patterns: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of votes with mutual information over 0.01 given the balance of all others, the most first.

        Judged before the fit: two votes that copy each other would else be taken for the truth itself.
        """
        found = []
        for i, j in itertools.combinations(range(patterns.shape[1]), 2):
            balance, info = np.sign(patterns.sum(1) - patterns[:, i] - patterns[:, j]), 0.0
            for c in (-1, 0, 1):
                t = np.zeros((3, 3))
                np.add.at(t, (patterns[balance == c, i] + 1, patterns[balance == c, j] + 1), counts[balance == c])
                if t.sum() > 0:
                    p = t / t.sum()
                    e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                    info += t.sum() / counts.sum() * float((p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum())
            if info > 0.01:
                found.append((info, (i, j)))
        return [pair for _, pair in sorted(found, key=lambda x: (-x[0], x[1]))]


def read_records(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Number, letter, unit, street, kinds, directions and locality of ``records``, names settled against the whole of them."""
    number, unit = addresses.bare_column(F.col("number")), addresses.bare_column(F.col("unit"))
    form = r"(\d+)\s*-?\s*([a-z](?![a-z]))?"
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"^0+(?=\d)", "")
    named = F.filter(F.transform(F.col("_street"), lambda w: F.regexp_replace(w, r"\.$", "")), addresses.name_column)
    parsed = records.filter("number is not null and street is not null").select(
        "rec", "dataset", "lon", "lat", plain(F.regexp_extract(number, form, 1)).alias("number"), F.regexp_extract(number, form, 2).alias("letter"),
        F.coalesce(plain(F.regexp_extract(unit, r"\d+\s?[a-z]?|[a-z]$", 0)), F.lit("")).alias("unit"), F.coalesce(F.regexp_replace(addresses.bare_column(F.col("postcode")), "[^a-z0-9]", ""), F.lit("")).alias("postcode"),
        F.coalesce(addresses.bare_column(F.col("region")), F.lit("")).alias("region"), addresses.street_words(F.col("street")).alias("_street"), addresses.street_words(F.col("locality")).alias("_locality"),
    )
    words = F.concat(F.array(F.lit("@")), "_street", F.array(F.lit(",")), "_locality")
    parsed = scratch.write(parsed.withColumn("words", words).withColumn("spelt", F.array_join(named, "")).drop("_street", "_locality")).filter("number <> ''")
    lex = addresses.lexicon(records.select(F.col("street").alias("text"), "number"), records.select(F.col("locality").alias("text")), scratch)
    settled = addresses.settle_words(parsed.select("rec", "words"), ["rec"], lex, scratch)
    settled = settled.select("rec", "street", "kinds", "directions", F.array_join("localities", " ").alias("locality"))
    return scratch.write(parsed.drop("words").join(settled, "rec"))


def candidates(read: DataFrame) -> DataFrame:
    """Pairs of records of different datasets with number, unit and street alike and a place in common."""
    half = lambda v, s: F.floor(v + s).cast("string")

    def cells(lon, lat, also=F.lit(True)):  # four grids, shifted by half a cell: neighbours share a cell of one of them
        x, y = lon * F.cos(F.radians(F.floor(lat / 5) * 5)) / CELL_DEG, lat / CELL_DEG
        return [F.when(is_point(lon, lat) & also, F.concat_ws(":", F.lit(f"c{i}{j}"), half(x, i / 2), half(y, j / 2))) for i in (0, 1) for j in (0, 1)]

    # coordinates in the wrong order are tried too where nothing else tells the place
    bare = (F.col("locality") == "") & (F.col("postcode") == "")
    at = cells(F.col("lon"), F.col("lat")) + cells(F.col("lat"), F.col("lon"), bare)
    places = F.array_compact(F.array(F.when(F.col("locality") != "", F.concat(F.lit("l:"), F.col("locality"))), F.when(F.col("postcode") != "", F.concat(F.lit("p:"), F.col("postcode"))), *at))
    keyed = read.select("rec", F.xxhash64("dataset").alias("d"), F.explode(F.transform(places, lambda p: F.xxhash64("number", "letter", "unit", "street", p))).alias("block"))
    a, b = (keyed.select("block", F.col("rec").alias(f"rec_{s}"), F.col("d").alias(f"d_{s}")) for s in "ab")
    pairs = a.join(b, "block").filter("rec_a < rec_b and d_a <> d_b").select("rec_a", "rec_b").distinct()
    rest = ["number", "letter", "unit", "street", "kinds", "directions", "locality", "postcode", "region", "spelt", "lon", "lat"]
    for s in "ab":
        pairs = pairs.join(read.select(F.col("rec").alias(f"rec_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in rest]), f"rec_{s}")
    return pairs.filter("number_a = number_b and letter_a = letter_b and unit_a = unit_b and street_a = street_b")  # hashes of a block may clash


def votes(pairs: DataFrame) -> DataFrame:
    """The matching functions: 1 agree, -1 differ, 0 no opinion."""
    both = lambda c: (F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != "")
    vote = lambda known, agree: F.when(~known, 0).when(agree, 1).otherwise(-1).cast("int")
    plain = distance_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    turned = distance_m(F.col("lon_a"), F.col("lat_a"), F.col("lat_b"), F.col("lon_b"))  # one side in the wrong order
    metres = F.least(plain, turned)
    known = is_point(F.col("lon_a"), F.col("lat_a")) & is_point(F.col("lon_b"), F.col("lat_b"))
    kinds = (F.size("kinds_a") > 0) & (F.size("kinds_b") > 0)
    return pairs.select(
        "rec_a", "rec_b",
        vote(both("locality"), (F.levenshtein("locality_a", "locality_b") <= 2) | F.arrays_overlap(F.split("locality_a", " "), F.split("locality_b", " "))).alias("v_locality"),
        vote(both("postcode"), F.col("postcode_a") == F.col("postcode_b")).alias("v_postcode"),
        F.when(~known, 0).when(metres <= 150, 1).when(metres > 600, -1).otherwise(0).cast("int").alias("v_distance"),
        vote(kinds, F.arrays_overlap("kinds_a", "kinds_b")).alias("v_kind"),
        vote(F.lit(True), F.col("directions_a") == F.col("directions_b")).alias("v_direction"),
        F.when(F.col("spelt_a") == F.col("spelt_b"), 1).otherwise(0).cast("int").alias("v_spelling"),
        vote(both("region"), F.levenshtein("region_a", "region_b") <= 2).alias("v_region"),
    )


def link_records(records: DataFrame, accept: float = 0.5) -> DataFrame:
    """``(rec_a, rec_b, confidence)`` of records of different datasets that describe one address.

    ``records(rec, dataset, number, street, unit, postcode, locality, region, lon, lat)``. Rows without rec,
    dataset, number or street pair with nothing; nor do rows without any of locality, postcode and usable
    coordinates, whose place is unknown. Rows that repeat a rec count once (any of them). Empty tables give no
    pairs. House number, letter and unit must be the same; all else is weighed. Records meet by hash and id alone, a pair once,
    and what the functions vote on is fetched for pairs only. Only the vote patterns, at most 3 to the number
    of functions, come to the driver; the confidence of each goes back by a join.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "linkage")
    records = records.filter("rec is not null and dataset is not null").dropDuplicates(["rec"])
    read = read_records(records, scratch)
    voted = scratch.write(votes(candidates(read)))
    counts = voted.groupBy(*VOTES).count().toPandas()
    if len(counts):
        patterns = counts[VOTES].to_numpy()
        counts["confidence"] = LabelModel(vetoes=tuple(map(VOTES.index, VETOES))).fit(patterns, counts["count"].to_numpy(float)).predict(patterns)
    else:
        counts["confidence"] = pd.Series(dtype=float)
    scores = spark.createDataFrame(counts[[*VOTES, "confidence"]], ", ".join(f"{v} int" for v in VOTES) + ", confidence double")
    scored = voted.join(F.broadcast(scores), VOTES)
    return scored.filter(F.col("confidence") >= accept).select("rec_a", "rec_b", "confidence")
