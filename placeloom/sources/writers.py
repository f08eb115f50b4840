"""Sinks: published generations of a table, and batch output with coordinates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, root: str) -> str:
    """K1, K5: write a new generation under ``root``, count it, then replace the pointer file in one rename.

    Rows are counted as they are written; a generation that reads back another number raises ``OSError`` and is not pointed at.
    The rename overwrites, so that a reader always finds the old pointer or the new one.
    """
    spark = df.sparkSession
    name = f"generation-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{name}")
    read = spark.read.parquet(f"{root}/{name}").count()
    if read != written.get["n"]:
        raise OSError(f"{read} rows of {written.get['n']} in {name}")
    replace_file(spark, f"{root}/CURRENT", name.encode())
    return name


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """K5: a small file written beside its place and moved over it."""
    beside, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(content))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(_fs(spark, path)[0]), overwrite)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The generation that the pointer names."""
    name = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{name}")


def with_coordinates(rows: DataFrame, hits: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """K3: ``rows`` with coordinates of ``hits(key, lat, lon)`` written in; columns of those names in any case are reused."""
    names = {c.lower(): c for c in rows.columns}
    lat_as, lon_as = names.get(lat.lower(), lat), names.get(lon.lower(), lon)
    kept = rows.drop(lat_as, lon_as)
    order = rows.columns + [c for c in (lat_as, lon_as) if c not in rows.columns]
    return kept.join(hits.select(key, hits["lat"].alias(lat_as), hits["lon"].alias(lon_as)), key, "left").select(*order)
