"""Keyed running totals over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.shared import shared_path


def running_totals(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """Count, sum and last time of each key; as a stream, in update or complete mode."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max("ts").alias("last_ts"))


def run_available(spark: SparkSession, folder: str, schema, checkpoint: str, out: str | None = None) -> DataFrame:
    """All files of ``folder`` as a stream, once; the final totals, read from ``out``, a folder of the shared store."""
    return taken(running_totals(spark.readStream.schema(schema).parquet(folder)), checkpoint, out)


def taken(totals: DataFrame, checkpoint: str, out: str | None = None) -> DataFrame:
    """Totals of a stream at its end. Every batch's totals are written over those of the one before; none come to the driver."""
    spark = totals.sparkSession
    out = out or shared_path(spark, "totals")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    spark.createDataFrame([], totals.schema).write.mode("overwrite").parquet(out)  # a stream without a row has no batch
    totals.writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(out)
