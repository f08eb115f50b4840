"""Reverse look-ups over a stream of pings, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from placeloom.operators.relational import nearest

PING = "ping_id bigint, ts timestamp_ntz, received_at timestamp_ntz, client_id string, lon double, lat double, accuracy_m double, distance_m double"


def reverse_stream(spark: SparkSession, source: str, places: DataFrame, sink: str, checkpoint: str, radius_m: float = 30.0) -> StreamingQuery:
    """Read Parquet files of pings as they arrive and append ``ping_id, rec_id, distance_m`` of the nearest place.

    Each micro-batch is the batch operator on its rows; batches are written under their number, so one that is run
    again after a failure overwrites itself.
    """
    pings = spark.readStream.schema(PING).option("maxFilesPerTrigger", 16).parquet(source)

    def handle(batch: DataFrame, number: int) -> None:
        found = nearest(batch, places, radius_m, "ping_id", "rec_id").select("ping_id", "rec_id", "distance_m")
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
