"""Row-level operators of the record build: validation, choice of sources, area checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.functions import text
from placeloom.operators.proximity import is_point


def validate_imports(rows: DataFrame) -> DataFrame:
    """Adds ``reason`` (null for a valid row) and ``locality`` to imported address rows.

    Reasons, the first that holds: missing_number, missing_street, bad_coordinates (missing, not finite, out of
    range or exactly 0,0). The locality is the city, else the district. Narrow.
    """
    number, street = text.collapse_whitespace(F.col("number")), text.collapse_whitespace(F.col("street"))
    reason = F.when(number.isNull(), "missing_number").when(street.isNull(), "missing_street").when(~is_point(F.col("lon"), F.col("lat")), "bad_coordinates")
    city = F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.col("district"))
    return rows.withColumn("reason", reason).withColumn("locality", text.collapse_whitespace(city))


def importance(views: Column) -> Column:
    """View counts on a scale of 1 to 255."""
    return F.greatest(F.lit(1), F.least(F.lit(255), F.floor(1 + 7.5 * F.log2(views + 1)))).cast("int")


def sources_for(files: DataFrame, countries: DataFrame) -> DataFrame:
    """``dataset, path, country, rank``: the newest file of each data set under a covered country, subdivisions first."""
    newest = Window.partitionBy("dataset").orderBy(F.desc("path"), F.desc_nulls_last("entry"))
    one = files.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    prefix = F.concat(F.lit("openaddresses:"), F.lower("country"), F.lit("/"))
    met = one.withColumn("country", F.upper(F.regexp_extract("dataset", "^openaddresses:([a-z]{2})/", 1))).join(countries, "country")
    rank = F.when(F.col("dataset").startswith(F.concat(prefix, F.lit("0"))), 1).otherwise(2)
    return met.select("dataset", "path", "country", rank.alias("rank"))


def within_stated_area(rows: DataFrame, files: DataFrame, boxes: DataFrame, probe: int = 1000) -> DataFrame:
    """``rec_id, dataset`` of rows inside the area their file states; none of a file most of whose first rows lie outside.

    ``boxes(country, w, s, e, n)``. Files that state no area, and areas without a box, are left out.
    """
    stated = files.filter("area is not null").select("dataset", F.col("area").alias("country")).distinct().join(boxes, "country")
    inside = F.coalesce(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")), F.lit(False))
    judged = rows.join(stated, "dataset").select("rec_id", "dataset", "file_row", inside.alias("inside"))
    # the first rows: ranked within pieces of a file, then among the pieces' firsts, so that no file is sorted in one task
    first = judged.withColumn("_p", F.pmod(F.xxhash64("rec_id"), F.lit(64)))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("dataset", "_p").orderBy("file_row", "rec_id"))).filter(F.col("_r") <= probe)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy("file_row", "rec_id"))).filter(F.col("_r") <= probe)
    good = first.groupBy("dataset").agg(F.avg(F.col("inside").cast("double")).alias("share")).filter("share >= 0.5").select("dataset")
    return judged.filter("inside").join(good, "dataset").select("rec_id", "dataset")


def strictest(candidates: DataFrame, key: str, level: str) -> DataFrame:
    """The candidates of each key at the strictest level that any of them meets."""
    best = candidates.groupBy(key).agg(F.max(level).alias("_best"))
    return candidates.join(best, key).filter(F.col(level) == F.col("_best")).drop("_best")
