"""Normalising comment records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from throng.sources import records


def read_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def normalised(raw: DataFrame, now: float) -> DataFrame:
    """The ten comment columns of a stream of raw records with a ``cid``; the
    normaliser looks at one row at a time, so it is the same as for a table."""
    return records.normalise(raw, now)


def hourly_counts(comments: DataFrame, late: str = "2 hours") -> DataFrame:
    """Comments and likes of each hour of publication, rows later than ``late``
    left out."""
    dated = comments.where("published_ts is not null").withColumn("at", F.timestamp_seconds("published_ts"))
    by = dated.withWatermark("at", late).groupBy(F.window("at", "1 hour"))
    return by.agg(F.count(F.lit(1)).alias("comments"), F.sum("likes").alias("likes")).select(F.col("window.start").alias("hour"), "comments", "likes")


def append(comments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet folder, each row once, then stop."""
    return comments.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
