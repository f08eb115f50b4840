"""Text search over records: an inverted index as tables, BM25, prefixes, typo expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from placeloom.operators.relational import lowest_per_group
from placeloom.runtime import Scratch

K1 = 1.2


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: never broadcast. A few MB of Parquet can be more than the driver's heap as rows."""
    return df.hint("merge")


def index_terms(docs: DataFrame, doc_id: str, key: Column) -> DataFrame:
    """``(doc, term, tf)`` of the words of a search key; documents without words have none."""
    words = docs.select(F.col(doc_id).alias("doc"), F.explode(F.split(key, " ")).alias("term")).filter("term != ''")
    return words.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


HOT = 2000  # words with more than this part of all postings: as many at most, whatever the size
PIECE = 20_000  # documents of a hot word that are scored together


def _scored(k: int, doc_type: pa.DataType):
    """The ``k`` best documents of each set of words within a part, the documents of one word; a bucket of parts at a time."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs = docs.sort_by([("part", "ascending"), ("doc", "ascending")]).combine_chunks()
        asked = asked.combine_chunks()
        out: dict[str, list] = {"i": [], "row": [], "value": []}
        n = docs.num_rows
        if n and asked.num_rows:
            one = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
            parts = pc.dictionary_encode(one(docs, "part"))
            part = parts.indices.to_numpy()
            starts = np.searchsorted(part, np.arange(len(parts.dictionary) + 1))
            words = pc.split_pattern(one(docs, "words"), " ")
            codes = pc.dictionary_encode(words.flatten())
            size = len(codes.dictionary)
            row = np.repeat(np.arange(n, dtype=np.int64), pc.list_value_length(words).to_numpy())
            posts, tf = np.unique((part[row].astype(np.int64) * size + codes.indices.to_numpy()) * n + row, return_counts=True)
            key, row, gain = posts // n, posts % n, tf * (K1 + 1) / (tf + K1)
            terms = pc.split_pattern(one(asked, "w"), " ")
            idf = one(asked, "idf").flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy())))
            where = pc.fill_null(pc.index_in(one(asked, "part"), value_set=parts.dictionary), -1).to_numpy()
            code = pc.fill_null(pc.index_in(terms.flatten(), value_set=codes.dictionary), -1).to_numpy().astype(np.int64)
            want = np.repeat(where, np.diff(ends)).astype(np.int64) * size + code
            lo, hi = np.searchsorted(key, want), np.searchsorted(key, want, side="right")
            hi = np.where(code < 0, lo, hi)
            for i in np.flatnonzero(where >= 0):
                start, end = starts[where[i]], starts[where[i] + 1]
                score = np.zeros(end - start)
                for j in range(ends[i], ends[i + 1]):
                    if lo[j] < hi[j]:
                        score[row[lo[j] : hi[j]] - start] += idf[j] * gain[lo[j] : hi[j]]
                if len(score) > k:
                    shown = np.floor(score * 1e6 + 0.5)
                    least = np.partition(shown, len(shown) - k)[len(shown) - k]
                    above = np.flatnonzero(shown > least)
                    best = np.concatenate((above, np.flatnonzero(shown == least)[: k - len(above)]))
                else:
                    best = np.arange(len(score))
                out["i"].append(np.full(len(best), i))
                out["row"].append(best + start)
                out["value"].append(score[best])
        i, row, value = (np.concatenate(v) if v else np.array([], dtype=float if c == "value" else int) for c, v in out.items())
        return pa.table({"w": asked["w"].take(pa.array(i)).cast(pa.string()), "doc": docs["doc"].take(pa.array(row)).cast(doc_type), "value": pa.array(value, pa.float64())})

    return run


def bm25_top(index: DataFrame, queries: DataFrame, query_id: str, key: Column, k: int = 5) -> DataFrame:
    """``(query_id, doc, score, rank)``: best documents by BM25 without length norms, ties by document.

    Every document with any word of a query counts; those that cannot be among the best are skipped by an exact bound
    (MaxScore). Documents of a query's rarest words are scored first, the k-th best of them is a floor. Words so common
    that all of them together stay below the floor fetch no documents by themselves. Queries of the same words are answered once.

    Documents are scored beside the word that fetches them, whole documents against whole queries, and only the ``k`` best of each
    word leave the task: pairs of a query and a document are never shuffled or written. The documents of a hot word are cut into
    pieces; hot words that fetch nothing are left out before the shuffle.
    """
    scratch = Scratch(index.sparkSession, "bm25")
    slack = 1e-5  # over what rounding to six digits can move
    repeated = F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int"))))
    docs = scratch.write(index.groupBy("doc").agg(F.array_join(F.array_sort(repeated), " ").alias("words")))
    doc_type = to_arrow_type(docs.schema["doc"].dataType)
    said = docs.select("doc", "words", F.explode(F.array_distinct(F.split("words", " "))).alias("term"))
    repeats = docs.select(F.explode(F.split("words", " ")).alias("term"), "doc").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")).filter("tf > 1")
    most = repeats.groupBy("term").agg(F.max("tf").alias("more"))
    n = docs.count()
    counted = said.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(grows(most), "term", "left").withColumn("most", F.coalesce("more", F.lit(1)))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = scratch.write(counted.select("term", "df", idf.alias("idf"), (idf * F.col("most") * (K1 + 1) / (F.col("most") + K1)).alias("bound")))
    postings = words.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    asked = queries.select(F.col(query_id).alias("q"), F.explode(F.split(key, " ")).alias("term")).join(grows(words.select("term")), "term")
    asked = scratch.write(asked.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("w")))
    rarest = Window.partitionBy("w").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    commonest = Window.partitionBy("w").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = asked.select("w").distinct().select("w", F.explode(F.split("w", " ")).alias("term")).join(grows(words), "term")
    terms = terms.withColumn("first", F.coalesce(F.sum("df").over(rarest), F.lit(0)) < 4 * k)
    inner = F.array_sort(F.collect_list(F.struct("term", "idf")).over(Window.partitionBy("w")))["idf"]
    terms = scratch.write(terms.withColumn("sum", F.sum("bound").over(commonest)).withColumn("idf", inner).drop("bound"))
    buckets = max(12, postings // 50_000)

    def best(fetch: DataFrame) -> DataFrame:
        used = fetch.select("term").distinct().withColumn("used", F.lit(True))
        hot = words.filter(F.col("df") * HOT > postings).select("term", F.ceil(F.col("df") / PIECE).cast("int").alias("pieces")).join(used, "term", "left")
        hot = F.broadcast(scratch.write(hot))
        part, bucket = F.concat_ws(" ", "term", "piece").alias("part"), F.pmod(F.xxhash64("term", "piece"), F.lit(buckets)).alias("bucket")
        pieces = F.coalesce("pieces", F.lit(1))
        held = said.join(hot, "term", "left").filter("pieces is null or used").withColumn("piece", F.pmod(F.xxhash64("doc"), pieces).cast("int")).select(bucket, part, "doc", "words")
        sought = fetch.join(hot, "term", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select(bucket, part, "w", "idf")
        w_doc = StructType([StructField("w", StringType()), docs.schema["doc"], StructField("value", DoubleType())])
        found = held.groupBy("bucket").cogroup(sought.groupBy("bucket")).applyInArrow(_scored(k, doc_type), w_doc)
        return scratch.write(found)

    some = best(terms.filter("first"))
    top = lowest_per_group(some.groupBy("w", "doc").agg(F.max("value").alias("value")), ["w"], [F.desc("value"), "doc"], k)
    floor = top.groupBy("w").agg((F.min("value") - slack).alias("floor"), F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == k)
    rest = terms.join(grows(floor), "w", "left").filter("not first and (floor is null or sum >= floor)")
    found = some.unionByName(best(scratch.write(rest.select("w", "term", "idf"))))
    sums = found.groupBy("w", "doc").agg(F.round(F.max("value"), 6).alias("score"))
    return asked.join(grows(lowest_per_group(sums, ["w"], [F.desc("score"), "doc"], k)), "w").select(F.col("q").alias(query_id), "doc", "score", "rank")


def deletions(word: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def gaps(word: Column, twice: Column) -> Column:
    """What is left of a word without one letter, or two where ``twice`` holds; the first letter stays."""
    tail = F.substring(word, F.lit(2), F.length(word))
    once = deletions(tail)
    two = F.array_distinct(F.concat(once, F.flatten(F.transform(F.filter(once, lambda x: F.length(x) > 0), deletions))))
    return F.transform(F.when(twice, two).otherwise(once), lambda t: F.concat(F.substring(word, 1, 1), t))


def typo_expansion(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(word, correction, n)``: vocabulary words that a word of four letters or more may stand for.

    One edit away for four to six letters, two for a longer word, and more common than the word itself. The first
    letter stays, numbers are left alone. ``words(word)``, ``vocabulary(term, n)``. Words meet over a shared deletion
    instead of in pairs.
    """
    own = vocabulary.select(F.col("term").alias("word"), F.col("n").alias("own"))
    said = words.select("word").distinct().filter("length(word) >= 4 and not word rlike '[0-9]'").join(own, "word", "left").fillna(0, ["own"])
    left = said.select("word", "own", F.explode(gaps(F.col("word"), F.length("word") >= 7)).alias("gap"))
    right = vocabulary.filter("length(term) >= 3 and not term rlike '[0-9]'").select("term", "n", F.explode(gaps(F.col("term"), F.length("term") >= 5)).alias("gap"))
    near = "levenshtein(word, term) <= if(length(word) >= 7, 2, 1) and left(word, 1) = left(term, 1)"
    met = left.join(right, "gap").filter(f"word != term and n > own and {near}")
    return met.select("word", F.col("term").alias("correction"), "n").distinct()


def autocomplete(typed: DataFrame, lines: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, name, how, house, rank)``: Q12 and Q22, lines that what is typed may be the beginning of.

    ``typed(query_id, key)``, ``lines(line, number)``, a row each address. The first word of a key that is a house number is
    taken off; lines that hold that house come first (``house``), then common ones. ``how`` 1: the words stand in a line one after
    the other, the last as a prefix; 2, only where no line does so: all but the last stand in it in any order, the last as a prefix.
    Fewer than two characters without the number answer nothing. Keys are used whole, equal ones are answered once.

    Lines meet the typed words over the word before the last and the last as a prefix, for lone words over the prefix, of which
    only those asked for are kept; in any order over the rarest whole word. All joins are merge joins.
    """
    scratch = Scratch(typed.sparkSession, "autocomplete")
    number = r"(^| )([0-9]{1,5}[a-z]?)( |$)"
    first = F.nullif(F.regexp_extract("key", number, 2), F.lit(""))
    cut = F.regexp_replace("key", rf"^(.*?){number}", "$1 ")  # the first house number alone
    words = F.trim(F.regexp_replace(F.when(first.isNotNull(), cut).otherwise(F.col("key")), " +", " "))
    asked = scratch.write(typed.filter("key is not null").select("query_id", first.alias("number"), words.alias("words")).filter("length(words) >= 2"))
    houses = scratch.write(lines.filter("line is not null").groupBy("line", "number").agg(F.count(F.lit(1)).alias("n")))
    known = scratch.write(houses.groupBy("line").agg(F.sum("n").alias("n")))
    v = F.split("words", " ")
    texts = asked.select("words").distinct().withColumn("last", F.element_at(v, -1)).withColumn("before", F.coalesce(F.get(v, F.size(v) - 2), F.lit("")))
    texts = scratch.write(texts)
    w = F.split("line", " ")
    places = known.select("line", F.posexplode(w).alias("at", "word"), w.alias("w"))
    starts = places.select("line", "word", F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).otherwise("").alias("ahead"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("last"))
    # a word's prefixes stand both for themselves alone and behind the word before
    heads = starts.select("line", "last", F.explode(F.array_distinct(F.array("ahead", F.lit("")))).alias("before"))
    met = texts.join(grows(heads), ["before", "last"]).filter(F.concat(F.lit(" "), "line").contains(F.concat(F.lit(" "), "words"))).select("words", "line").distinct()
    met = scratch.write(met)
    open_ = texts.join(grows(met), "words", "left_anti").filter("before <> ''")
    df = places.groupBy("word").agg(F.countDistinct("line").alias("df"))
    wanted = open_.select("words", "last", F.array_distinct(F.slice(v, F.lit(1), F.size(v) - 1)).alias("whole"))
    counted = wanted.select("words", "last", "whole", F.explode("whole").alias("word")).join(grows(df), "word")
    rarest = counted.groupBy("words", "last", "whole").agg(F.min(F.struct("df", "word")).alias("r"), F.count(F.lit(1)).alias("c")).filter(F.col("c") == F.size("whole"))
    loose = rarest.select("words", "last", "whole", F.col("r.word").alias("word")).join(grows(places.select("line", "word", "w").distinct()), "word")
    loose = loose.filter((F.size(F.array_except("whole", "w")) == 0) & F.concat(F.lit(" "), "line").contains(F.concat(F.lit(" "), "last"))).select("words", "line").distinct()
    both = met.withColumn("how", F.lit(1)).unionByName(loose.withColumn("how", F.lit(2))).join(grows(known), "line")
    forms = asked.select("number", "words").distinct().join(grows(both), "words")
    have = houses.filter("number is not null").select("line", "number", F.lit(1).alias("house"))
    forms = forms.join(grows(have), ["line", "number"], "left").fillna(0, ["house"])
    best = lowest_per_group(forms.select("number", "words", "line", "how", "house", "n"), ["number", "words"], [F.desc("house"), F.desc("n"), "line"], k)
    best = best.select(F.coalesce("number", F.lit("")).alias("number"), "words", F.col("line").alias("name"), "how", "house", "rank")
    return asked.fillna("", ["number"]).join(grows(best), ["number", "words"]).select("query_id", "name", "how", "house", "rank")
