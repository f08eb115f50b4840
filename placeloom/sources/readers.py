"""Readers of address files, each to the layout ``number, street, unit, city, district, region, postcode, lon, lat``."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["number", "street", "unit", "city", "district", "region", "postcode"]
_FEATURE = "geometry struct<coordinates: array<double>>, properties struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">, _corrupt string"


def geojson_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: rows of a file of one Feature a line (gzip by extension), and the lines that are none, with ``line``.

    A feature without coordinates has null ones; blank lines are skipped.
    """
    rows = spark.read.schema(_FEATURE).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", rows.schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.filter("r is not null and r._corrupt is null").select(
        *[F.col(f"r.properties.{f}").alias(f) for f in FIELDS], F.get("r.geometry.coordinates", F.lit(0)).alias("lon"), F.get("r.geometry.coordinates", F.lit(1)).alias("lat")
    )
    return good, parsed.filter("r is null or r._corrupt is not null").select(F.col("value").alias("line"))


def address_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, names in any case; LON, LAT, NUMBER and STREET required, missing others null."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)
    by = {c.lower(): c for c in raw.columns}
    lacking = [c for c in ("lon", "lat", "number", "street") if c not in by]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    text = [F.col(f"`{by[f]}`").alias(f) if f in by else F.lit(None).cast("string").alias(f) for f in FIELDS]
    return raw.select(*text, *[F.expr(f"try_cast(`{by[c]}` as double)").alias(c) for c in ("lon", "lat")])


def zip_entry_lines(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """``line`` of one entry of each archive, unpacked as it is read (gzip inside it too); none if it isn't there.

    Archives are listed, not loaded: a task opens the file through the session's file system, finds the entry in the
    directory at its end and reads on from the entry's own offset. ``path`` may be a pattern; archives are read in parallel.
    """
    import pyarrow.fs as afs

    listed = spark.read.format("binaryFile").load(path).select("path")  # contents are not read for their path alone

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                source, at = afs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                with source.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
                    if entry in archive.namelist():
                        raw = archive.open(entry)
                        stream = gzip.open(raw) if entry.endswith(".gz") else raw
                        lines = []
                        for line in io.TextIOWrapper(stream, "utf-8", errors="replace"):
                            lines.append(line.rstrip("\r\n"))
                            if len(lines) >= 10_000:
                                yield pd.DataFrame({"line": lines})
                                lines = []
                        yield pd.DataFrame({"line": lines})

    return listed.mapInPandas(read, "line string")


def view_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``item, views, importance`` of a CSV of ``Qnnn,views``; an item counts once, by its most views."""
    from placeloom.functions.text import wikidata_item
    from placeloom.operators.records import importance

    raw = spark.read.option("header", True).csv(path).toDF("entity", "views")
    rows = raw.select(wikidata_item(F.col("entity")).alias("item"), F.expr("try_cast(views as bigint)").alias("views")).dropna()
    return rows.groupBy("item").agg(F.max("views").alias("views")).withColumn("importance", importance(F.col("views")))
