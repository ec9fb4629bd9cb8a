"""The streaming face: quotes as an unbounded table. Results of a finished stream equal those of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quotes(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_observations(stream: DataFrame, keys: list[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """Each (key, time) once; state older than the watermark is dropped."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([*keys, at])


def buckets(stream: DataFrame, at: str, value: str, width: str = "300 seconds", lateness: str = "1 hour") -> DataFrame:
    """Count and sum of fixed UTC windows, emitted once their watermark has passed."""
    per = stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("bucket"), "n", "total")


def latest_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str, tie: str):
    """Keep the latest row of each key in a table: each micro-batch is merged with the table and written as its next version."""
    from ledgerlark.operators.latest import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        latest(held.unionByName(batch), keys, at, tie).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
