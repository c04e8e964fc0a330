"""Streaming forms of windowed counts, deduplication and append with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of parquet files as a stream; new files are picked up as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, by: str, every: str = "1 hour", late: str = "1 hour", t: str = "ts") -> DataFrame:
    """Rows and sum of values for each window and kind; rows later than `late` are left out."""
    s = stream.withColumn("__t", F.col(t).cast("timestamp")).withWatermark("__t", late)
    g = s.groupBy(F.window("__t", every).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "1 hour", t: str = "ts") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn("__t", F.col(t).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Appends to parquet exactly once; a restart resumes from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
