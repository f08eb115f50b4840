"""Queries of the operators in this subpackage, on the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import addresses, bpe, linkage, lookalike, mixing, pii, same_address
from placeloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def address_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the map and of the address files in one layout; a label's postcode stands in for a missing one."""
    osm = addresses.numbers_first(table(spark, sf_dir, "osm_addresses").withColumnRenamed("unit", "_unit"), "label").select(
        F.col("rec_id").alias("rec"), "dataset", F.col("housenumber").alias("number"), "street", F.col("_unit").alias("unit"),
        F.coalesce("postcode", F.get("codes", F.lit(0))).alias("postcode"), "locality", "region", "lon", "lat",
    )
    rows = table(spark, sf_dir, "import_rows").select(
        F.col("rec_id").alias("rec"), "dataset", "number", "street", "unit", "postcode",
        F.coalesce("city", "district").alias("locality"), "region", "lon", "lat",
    )
    return osm.unionByName(rows)


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_records(address_records(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_records(address_records(spark, sf_dir)).select("rec_a", "rec_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    osm = table(spark, sf_dir, "osm_addresses")
    labels = osm.select(F.col("rec_id").alias("key"), F.col("label").alias("text"))
    texts = table(spark, sf_dir, "queries").select(F.col("query_id").alias("key"), F.col("q").alias("text"))
    return same_address.same_address_pairs(
        labels.unionByName(texts), osm.select(F.col("street").alias("text"), F.col("housenumber").alias("number")), osm.select(F.col("locality").alias("text")),
        codes=osm.select(F.col("postcode").alias("text")),
    )


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of addresses and texts of queries; a lone question mark is no text."""
    names = table(spark, sf_dir, "osm_addresses").select(F.lit("name").alias("field"), F.col("rec_id").alias("key"), F.col("name").alias("text"))
    texts = table(spark, sf_dir, "queries").select(F.lit("q").alias("field"), F.col("query_id").alias("key"), F.col("q").alias("text"))
    return names.unionByName(texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(_fields(spark, sf_dir), "field", "key", "text", ignore=["?"])


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields(spark, sf_dir).filter("text is not null")
    forms = lookalike.consistent_forms(fields, "text")
    return fields.distinct().join(forms, "text").select("field", "key", "form")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return out.withColumn("share", F.round("share", 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), pii.given_names(table(spark, sf_dir, "given_names"), "given"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"), pii.given_names(table(spark, sf_dir, "given_names"), "given"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (p1_found, p1_links, p2_found, p4_found, p4_forms, p7_ids, p8_mixture, p8_shares, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    return {}
